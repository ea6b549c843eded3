"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are runs of 16 or more characters of keys and digests anywhere in a text, web tokens whole, and whatever is assigned to
a name such as password, however short. Features of each: its length; how often its characters change class, and which classes
they are of; how much of it words of the corpus's dictionary make up; words of its path; the words around it, as hashes and as
names and assignments. A random forest learns from labelled findings which candidates are secrets; what it rejects stays in the
result, marked as no secret, so nothing is dropped.

``scan`` takes labelled findings as a table. ``seed_labels`` makes some where no reviewer's exist, by provider's published formats,
by names that a value is assigned to, by plain words and by addresses; the forest then learns without the features that those
rules read (``SEEDED``), so it has to tell secrets by their form and surroundings. Training uses at most ``each`` findings of
either label. tests/llm/test_secrets.py measures precision and recall on held-out findings that were labelled by hand.

Only DataFrame and SQL functions are used, and Spark's own random forest. Values leave as a digest and a masked form.

Rows: null or empty texts have no candidates; texts of any length are whole rows; rows that repeat give the same findings
each; null paths count as empty; where one label only can be learned from, every score is that label; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import SPACE, cut, lowest

VALUE = r"eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+|[A-Za-z0-9+/_\-]{16,}"
# Published formats of keys and tokens.
FORMATS = {
    "cloud key id": r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    "forge token": r"^gh[pousr]_[A-Za-z0-9]{36}$",
    "chat token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "web token": r"^eyJ[A-Za-z0-9_-]{10,}",
}
# Names that secrets are assigned to, and parts of paths that hold examples.
NAMES = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|auth|bearer|credential|private[_-]?key)"
SAMPLES = r"(?i)(test|example|sample|fixture|demo|doc)"

#: An assignment's mark after a name, and what encloses a value.
MARK, QUOTES = r"(:?=>?|:)", r"^[\"'`(\[{<]+|[\"'`)\]}>,;]+$"
#: Buckets of the hashes of neighbouring words and of path words.
NEAR, PATHS = 12, 6
SHAPE = ["length", "changes", "digits", "upper", "vowels", "marks", "distinct", "hex", "covered", "dictionary"]
CONTEXT = [*(f"{w}_{k}" for w in ("before", "after") for k in range(NEAR)), "neighbours"]
PATH = ["sample_path", "path_depth", *(f"path_{k}" for k in range(PATHS))]
#: What the seed labels' rules do not read.
SEEDED = [*(f for f in SHAPE if f != "digits"), *CONTEXT, *PATH]
FEATURES = [*SHAPE, "named", "assigned", *CONTEXT, *PATH]


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, path, at (the word's place), word, lead, value, part, named_value, before, before2, after: one row for each candidate."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    words = docs.where(F.col("text").rlike(VALUE) | F.col("text").rlike(NAMES)).select("doc_id", where.alias("path"), F.split("text", SPACE).alias("words"))
    near = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    inside = NAMES + r"[A-Za-z0-9_\-]*[\"'\]]*" + MARK + r"[^\s/=:].*"

    def assigned(i: Column) -> Column:
        """name=value in one word; name= value; name = value."""
        one = near(i - 1)
        return near(i).rlike("^[^/]*" + inside) | one.rlike(NAMES + r"[A-Za-z0-9_\-]*[\"'\]]*" + MARK + "$") | (one.rlike("^" + MARK + "$") & near(i - 2).rlike(NAMES))

    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (near(i) != "") & (near(i).rlike(VALUE) | (assigned(i) & ~near(i).rlike("^" + MARK + "$"))))
    item = lambda i: F.struct(i.alias("at"), near(i).alias("word"), near(i - 1).alias("before"), near(i - 2).alias("before2"), near(i + 1).alias("after"), assigned(i).alias("named_value"))
    rows = words.select("doc_id", "path", F.explode(F.transform(at, item)).alias("x")).select("doc_id", "path", "x.*")
    # what is assigned is one value, whatever its characters; elsewhere every run is one
    own = F.when(F.col("word").rlike("^[^/]*" + inside), F.regexp_replace("word", "^.*?" + NAMES + r"[A-Za-z0-9_\-]*[\"'\]]*" + MARK, "")).otherwise(F.col("word"))
    whole = F.regexp_replace(F.regexp_replace(own, QUOTES, ""), QUOTES, "")
    values = F.when(F.col("named_value"), F.array(whole)).otherwise(F.regexp_extract_all("word", F.lit(f"({VALUE})"), F.lit(0)))
    found = rows.select("*", F.posexplode(values).alias("part", "value")).where("value <> ''")
    return found.withColumn("lead", F.expr("substring_index(word, value, 1)"))


def dictionary(docs: DataFrame, size: int = 4000) -> list[str]:
    """The corpus's most common plain words of 3 to 10 letters, counted over all documents; ``size`` words at most are brought here."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(3, 10))
    rows = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size).collect()
    return [r["w"] for r in rows]


def features(found: DataFrame, common: list[str], stems: int = 400) -> DataFrame:
    """``found`` with a number for each of FEATURES."""
    v = F.col("value")
    n = F.length(v).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    # of the most common ``stems`` words, longer ones first, so that each stretch is covered by the longest
    words = "|".join(sorted(common[:stems], key=lambda w: (-len(w), w))) or "(?!)"
    runs = F.filter(F.split(F.lower(F.regexp_replace(v, "(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    known = F.filter(runs, lambda w: F.array_contains(F.array(*[F.lit(w_) for w_ in common]), w)) if common else F.array().cast("array<string>")
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")
    hashed = lambda c, k, m: (F.pmod(F.xxhash64(c), F.lit(m)) == k).cast("double")
    folders = F.split(F.lower("path"), r"[^\p{L}]+")
    before = F.when(F.col("before").rlike("^" + MARK + "$"), F.col("before2")).otherwise(F.col("before"))
    context = F.concat_ws(" ", "before2", "before", "lead")
    made: dict[str, Column] = {
        "length": n,
        "changes": share(r"(?<=[a-z])(?=[A-Z0-9+/_-])|(?<=[A-Z])(?=[0-9+/_-])|(?<=[0-9])(?=[A-Za-z+/_-])|(?<=[A-Z][A-Z])(?=[a-z])"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "vowels": share("(?i)[aeiou]"),
        "marks": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": F.lower(v).rlike("^[0-9a-f]+$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), words, "")) / n,
        "dictionary": F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / n,
        "named": context.rlike(NAMES).cast("double"),
        "assigned": (F.col("lead").rlike("[=:]") | F.col("before").rlike("[=:]>?$")).cast("double"),
        **{f"before_{k}": hashed(bare(before), k, NEAR) for k in range(NEAR)},
        **{f"after_{k}": hashed(bare(F.col("after")), k, NEAR) for k in range(NEAR)},
        "neighbours": (F.length("before") + F.length("after")) / 2.0,
        "sample_path": F.col("path").rlike(SAMPLES).cast("double"),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        **{f"path_{k}": F.array_contains(F.transform(folders, lambda w: F.pmod(F.xxhash64(w), F.lit(PATHS)).cast("int")), k).cast("double") for k in range(PATHS)},
    }
    return found.withColumns({k: c.cast("double") for k, c in made.items()})


def kind(value: Column) -> Column:
    out = None
    for name, pattern in FORMATS.items():
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out


def seed_labels(found: DataFrame) -> DataFrame:
    """The findings whose label a rule gives, with ``label``: 1 or 0."""
    v = F.col("value")
    yes = kind(v).isNotNull() | ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0))
    no = v.rlike(r"^\p{L}+$") & ((F.col("assigned") == 0) | (F.length(v) < 16)) | F.col("word").rlike(r"^(https?:|www\.|/|\.{1,2}/)")
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")


def forest(labelled: DataFrame, used: list[str], each: int = 4000, trees: int = 20, depth: int = 8, seed: int = 5):
    """A pipeline model, or the only label as a number. At most ``each`` findings a label, in a fixed order, train it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.select("label", "value", "before", "after", *FEATURES).withColumn("_draw", F.xxhash64(F.lit(seed), "value", "before", "after"))
    order = ["_draw", "value", "before", "after", *FEATURES]
    sample = cut(lowest(rows, "label", "_draw", each, order[1:]).repartition(1).sortWithinPartitions("label", *order).select("label", *used))
    seen = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.0
    stages = [VectorAssembler(inputCols=used, outputCol="_features"), RandomForestClassifier(labelCol="label", featuresCol="_features", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed)]
    return Pipeline(stages=stages).fit(sample)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, path, at, part, kind, value_sha256, masked, score, is_secret, removed for each candidate of ``docs``.

    ``labelled``: findings with FEATURES and ``label``; by default those of ``seed_labels``. ``removed``: a false positive.
    """
    from pyspark.ml.functions import vector_to_array

    found = cut(features(candidates(docs, path), dictionary(docs)))
    model = forest(seed_labels(found), SEEDED) if labelled is None else forest(labelled, FEATURES)
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(found).withColumn("score", F.round(vector_to_array("_probability")[1], 6))
    masked = F.concat(F.substring("value", 1, 4), F.lit("..."), F.length("value").cast("string"))
    return scored.select("doc_id", "path", "at", "part", F.coalesce(kind(F.col("value")), F.lit("generic")).alias("kind"), F.sha2("value", 256).alias("value_sha256"), masked.alias("masked"), "score", (F.col("score") >= threshold).alias("is_secret"), (F.col("score") < threshold).alias("removed"))
