from pyspark.sql import functions as F

from scholia.llm import secrets as S

from .conftest import rows


def fixture(spark):
    data = []
    for i in range(120):
        key = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[(i * 7 + k * 11 + k * k) % 32] for k in range(16))
        hexa = "".join("0123456789abcdef"[(i * 5 + k * 7 + k * k * i) % 16] for k in range(40))
        data.append((i, f"some words thetionofthewords and more internationalization then AKIA{key} plain words", f"src/{i}"))
        data.append((1000 + i, f"config token = \"{hexa}\" of the service", "conf/app"))
        data.append((2000 + i, f"a word incomprehensibilities{'s' * (i % 5)} in the middle of words", "docs/example"))
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def test_forest_separates(spark):
    got = S.scan(fixture(spark)).collect()
    hits = {r["doc_id"] for r in got if r["is_secret"]}
    assert {i for i in range(120)} | {1000 + i for i in range(120)} <= hits
    assert not {r["doc_id"] for r in got if r["removed"]} & set(range(1000, 1120))
    assert all(r["removed"] for r in got if r["doc_id"] >= 2000)
    assert {r["kind"] for r in got if r["is_secret"]} == {"cloud key id", "generic"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.scan(fixture(spark).repartition(5)).collect()))


def test_given_labels(spark):
    docs = fixture(spark)
    found = S.features(S.candidates(docs), ["words"])
    labelled = found.withColumn("label", F.when(F.col("doc_id") >= 2000, 1.0).otherwise(0.0))
    got = S.scan(docs, labelled).where("is_secret").select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in got} >= {2000 + i for i in range(120)} and all(r["doc_id"] >= 2000 or r["doc_id"] < 120 for r in got)


def test_candidates(spark):
    texts = ['password = "hunter2!"', "pwd: P@ss.w0rd#2024", "the token: eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl end", '{"api_key":"ab12"}', "secret=x", "PASSWORD=> 'it is' ", "no secret here", "x https://host/a/very_long_path_of_words y", "token =", "auth := Zz9"]
    got = {}
    for r in S.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["value"])
    assert got == {0: ["hunter2!"], 1: ["P@ss.w0rd#2024"], 2: ["eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl"], 3: ["ab12"], 4: ["x"], 5: ["it"], 7: ["//host/a/very_long_path_of_words"], 9: ["Zz9"]}


def labelled_by_hand(spark):
    """Texts whose candidates are known to be secrets or not: no rule of the module's is asked. (doc_id, text, source, truth)"""
    import random

    r = random.Random(8)
    letters, digits, marks = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!@#$%&*?"
    pick = lambda pool, n: "".join(r.choice(pool) for _ in range(n))
    words = ["internationalization", "the_configuration_of_services", "documentation-and-examples", "counterrevolutionaries", "user_profile_picture_large", "meeting", "required", "expires", "changed", "2024-01-15-release-notes", "chapter_12_section_34_notes"]
    plain = ["we", "read", "the", "report", "again", "and", "then", "sent", "it", "on"]
    out = []
    for i in range(600):
        secret = i % 2 == 0
        name = r.choice(["password", "token", "api_key", "client_secret"])
        lead = r.choice([f"{name} = ", f"{name}: ", "export KEY ", "use "])
        if secret:
            short = pick(letters + digits + marks, r.randrange(12, 20))
            value = r.choice([pick(letters + digits, r.randrange(20, 44)), short, pick("0123456789abcdef", 40)])
            lead = f"{name} = " if value == short else lead
        else:
            value = r.choice(words)
        out.append((i, f"{' '.join(r.sample(plain, 4))} {lead}{value} {' '.join(r.sample(plain, 3))}", r.choice(["app/conf", "docs/guide", "src/main"]), float(secret)))
    return spark.createDataFrame(out, "doc_id long, text string, source string, truth double")


def test_held_out_findings(spark):
    docs = labelled_by_hand(spark)
    found = S.features(S.candidates(docs), S.dictionary(docs)).join(docs.select("doc_id", F.col("truth").alias("label")), "doc_id")
    got = S.scan(docs, found.where("doc_id % 5 <> 0 and label is not null")).where("doc_id % 5 = 0").join(docs.select("doc_id", "truth"), "doc_id").collect()
    hits = [r for r in got if r["is_secret"]]
    right = sum(r["truth"] == 1 for r in hits)
    assert right / len(hits) > 0.9 and right / sum(r["truth"] == 1 for r in got) > 0.9
    assert len({r["doc_id"] for r in got if r["truth"] == 1}) == 60


def test_odd_rows(odd, none):
    got = S.scan(odd).collect()
    values = {(r["doc_id"], r["masked"]) for r in got}
    assert (10, "0123...40") in values and (10, "AKIA...20") in values and (5, "xxxx...200000") in values
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows()}
    assert S.scan(none).count() == 0
