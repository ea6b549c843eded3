"""Does a passage define a concept, explain it, or only list it in a catalogue?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.cleaning import let, trimmed
from scholia.functions.query import STOPWORDS, any_of

# What shows a catalogue, and lines of a schedule.
CATALOGUE = [
    r"danh\s+sách\s+(?:bài\s+học|khóa\s+học|video|tài\s+nguyên|mục\s+lục)",
    r"(?:kế\s+hoạch|lịch\s+trình|lịch\s+học|tiến\s+trình)\s+(?:học\s+tập|giảng\s+dạy|chi\s+tiết)?",
    r"(?:video|bài\s+tập)\s+và\s+(?:lịch\s+học|tài\s+liệu)",
    r"tài\s+liệu\s+bổ\s+sung\s+và\s+lịch",
    r"playlist",
    r"slide\s+bài\s+giảng",
]
SCHEDULE = r"^(?:tuần|buổi|tiết|bài|chương|lecture|week|session)\s+\d+[:.\-]"
DATED = r"^(?:tuần|buổi|tiết|lecture|week)\s+\d+"
DATED_INSIDE = r"(?:tuần|buổi|tiết)\s+\d+"
# Cues of a definition and of an explanation.
DEFINES = [
    "định nghĩa", "khái niệm", "được định nghĩa là", "được định nghĩa", "là giới hạn", "công thức", "nguyên lý", "ý nghĩa", "bản chất", "tính chất", "đặc điểm", "quy luật",
    "lý thuyết", "học thuyết", "hai điều kiện", "f(u + v)", "f(αu)", "f′(", "lim_", "definition", "meaning",
]
EXPLAINS = ["giải thích", "điều kiện áp dụng", "thành phần", "nội dung", "mô tả", "được hiểu là", "tức là", "cụ thể", "chứng minh", "áp dụng cho", "cung cấp kiến thức", "biểu diễn", "nêu ý nghĩa", "nêu rõ"]
PLAIN_DEFINITIONS = ["được định nghĩa là", "định nghĩa:", "khái niệm:"]


def content_words(concept: str) -> list[str]:
    import re

    return [w for w in re.findall(r"\w+", concept.lower()) if w not in STOPWORDS]


def role(text: Column, concepts: list[str], defines: list[str] = DEFINES, explains: list[str] = EXPLAINS) -> Column:
    """Struct (attached, explained, catalogue) of a passage for the concepts of a question.

    Attached: a cue of a definition in a line that names a concept (or all content words of one), in one of the two lines below it
    unless that is a dated line, or within 120 characters before and 160 behind a place where the concept stands, where no date is.
    Explained: a cue of an explanation near by, or enough text. The first line that attaches decides for a concept; concepts after an
    attached one can still explain, by the first line that names them.
    """
    t = trimmed(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    lines = F.filter(F.transform(F.split(low, "\n"), lambda x: trimmed(x)), lambda x: x != "")
    wanted = [c.strip().lower() for c in concepts if c.strip() and content_words(c)]
    return let(F.struct(t.alias("t"), low.alias("low"), lines.alias("lines")), lambda x: _role(x["t"], x["low"], x["lines"], wanted, defines, explains))


def _role(t: Column, low: Column, lines: Column, wanted: list[str], defines: list[str], explains: list[str]) -> Column:
    catalogue = F.exists(F.array(*[low.rlike("(?U)" + p) for p in CATALOGUE]), lambda x: x) | (F.size(F.filter(lines, lambda x: x.rlike("(?U)" + SCHEDULE))) >= 2)
    near = lambda i, n: F.array_join(F.slice(lines, i + 1, n), " ")
    explained = lambda part, least: any_of(part, explains) | (F.length(part) > least)
    dated = lambda y: y.rlike("(?U)" + DATED)
    below = lambda i, k: F.coalesce(F.get(lines, i + k), F.lit(""))
    attached = lambda e: F.struct(F.lit(True).alias("attached"), e.alias("explained"))

    def naming(c: str):
        words = content_words(c)

        def names(x: Column) -> Column:
            every = F.lit(len(words) >= 2)
            for w in words:
                every = every & F.contains(x, F.lit(w))
            return F.contains(x, F.lit(c)) | every

        return names

    def by_lines(x: Column, i: Column) -> Column:
        first = ~dated(x) & ~dated(below(i, 1)) & any_of(below(i, 1), defines)
        second = ~dated(x) & ~dated(below(i, 1)) & ~dated(below(i, 2)) & any_of(below(i, 2), defines)
        return F.when(any_of(x, defines), attached(explained(near(i, 3), 100))).when(first, attached(explained(near(i + 1, 4), 80))).when(second, attached(explained(near(i + 2, 4), 80)))

    def later(c: str) -> Column:
        """What a concept adds once another is attached: only the first line that names it counts, and no surroundings."""
        names = naming(c)
        lone = F.transform(lines, lambda x, i: F.when(names(x), F.coalesce(by_lines(x, i)["explained"], F.lit(False))))
        return F.coalesce(F.get(F.array_compact(lone), 0), F.lit(False))

    def first_line(c: str) -> Column:
        names = naming(c)

        def line(hit: Column, x: Column, i: Column) -> Column:
            return F.when(names(x), by_lines(x, i).when(~dated(x) & hit.isNotNull(), attached(any_of(hit, explains) | (F.length(t) > 120))))

        def windows(parts: Column) -> Column:
            """The surroundings of each place where the concept stands: the parts of the text between its places tell where."""
            size = len(c)
            begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * size)
            around = lambda b: F.substring(low, F.greatest(b - 120, F.lit(0)) + 1, b + size + 160 - F.greatest(b - 120, F.lit(0)))
            return F.when(F.size(parts) > 1, F.get(F.filter(F.transform(begins, around), lambda w: ~w.rlike("(?U)" + DATED_INSIDE) & any_of(w, defines)), 0))

        hits = let(F.split(low, "\\Q" + c + "\\E", -1), windows)
        return let(F.struct(hits.alias("hit")), lambda h: F.get(F.array_compact(F.transform(lines, lambda x, i: line(h["hit"], x, i))), 0))

    if wanted:

        def over(found: Column) -> Column:
            before, said = F.lit(False), F.lit(False)
            for k, c in enumerate(wanted):
                own = F.get(found, F.lit(k))
                said = said | F.when(before, later(c)).otherwise(F.coalesce(own["explained"], F.lit(False)))
                before = before | own.isNotNull()
            return F.struct(before.alias("attached"), said.alias("explained"))

        best = let(F.array(*[first_line(c) for c in wanted]), over)
    else:
        plain = any_of(low, PLAIN_DEFINITIONS)
        best = F.struct(plain.alias("attached"), (plain & (any_of(low, explains) | (F.length(t) > 120))).alias("explained"))
    return let(best, lambda b: F.struct(((t != "") & b["attached"]).alias("attached"), ((t != "") & b["explained"]).alias("explained"), ((t != "") & catalogue).alias("catalogue")))
