"""One consistent form of text: what looks the same compares equal.

Texts are exploded to positioned code points; a broadcast table gives each code point its decomposition,
with look-alike letters replaced by one representative; marks are ordered by combining class, recomposed
with their base, and the text is rebuilt. Case, accents, and raised or encircled figures stay.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lexispark.session import materialize

#: Characters without a shape of their own that are not of category Cc or Cf.
SHAPELESS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Short hyphens with the shape of U+002D.
HYPHENS = "\u2010\u2011"
#: Letters that a look-alike must not replace, as a dot or a stroke tells them apart.
KEPT = "ıȷ"


def _skeletons(spark: SparkSession, letters: list[str]) -> dict[str, str]:
    """Letter -> prototype by the Unicode security data in Spark's own ICU library; an error without it."""
    builder = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder
    if not callable(builder):
        raise RuntimeError("look-alikes need the ICU library that comes with Spark")
    checker = builder().build()
    out: dict[str, str] = {}
    for at in range(0, len(letters), 4000):
        part = letters[at : at + 4000]
        # One call for many letters; U+E000 (private use) parts them and is its own prototype.
        got = checker.getSkeleton("\ue000".join(part)).split("\ue000")
        if len(got) != len(part):
            raise RuntimeError("the ICU library does not map letters one by one")
        out.update(zip(part, got))
    return out


def _is_han(c: str) -> bool:
    return 0x3400 <= ord(c) <= 0x9FFF or ord(c) >= 0x20000


def look_alikes(skeletons: dict[str, str]) -> dict[str, str]:
    """Letter -> the representative of its class; classes hold letters of one prototype and one case."""
    classes: dict[tuple[str, str], list[str]] = defaultdict(list)
    loose: list[str] = []
    for c, s in skeletons.items():
        kind = unicodedata.category(c)
        if kind in ("Lu", "Ll"):
            classes[s, kind].append(c)
        else:
            loose.append(c)
    for c in loose:  # letters without case join the cased class of their prototype, small before capital
        s = skeletons[c]
        kind = next((k for k in ("Ll", "Lu") if any(x.isascii() for x in classes.get((s, k), ""))), "Lo")
        classes[s, kind].append(c)
    out = {}
    for members in classes.values():
        han = sorted(c for c in members if _is_han(c))
        if han:  # variants of one Han character differ in shape; only other scripts' letters may look like one
            members = [c for c in members if c not in han[1:]]
        best = han[0] if han else min(members)  # ASCII first
        out.update({c: best for c in members if c != best})
    return out


def _wanted(c: str) -> str | None:
    """The full decomposition of one code point under the rules of this form, or None if it has no shape."""
    if c in SHAPELESS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return None
    kind = unicodedata.category(c)
    if c.isspace() or kind in ("Zs", "Zl", "Zp") or c == "\u2800":
        return " "
    if kind == "Cc" or kind == "Cf" and unicodedata.bidirectional(c) not in ("AN", "AL"):
        return None
    if c in HYPHENS:
        return "-"
    tag, _, rest = unicodedata.decomposition(c).rpartition(">")
    to = "".join(chr(int(x, 16)) for x in rest.split())
    if not tag:
        return "".join(map(_wanted, to)) if to else c
    tag = tag[1:]
    if tag in ("wide", "narrow", "noBreak", "initial", "medial", "final", "isolated"):
        return "".join(_wanted(x) or "" for x in to)
    if tag == "compat":  # joined letters, letters used as numerals, radicals; not signs, symbols or figures in brackets
        radical = 0x2E80 <= ord(c) <= 0x2FDF
        joined = kind[0] == "L" and len(to) > 1 and not 0x3130 <= ord(c) <= 0x318F
        if (radical or joined or kind == "Nl") and all(unicodedata.category(x)[0] in "LM" for x in to):
            return "".join(map(_wanted, to))
    return c


@functools.lru_cache(4)
def _tables(key: int) -> tuple[list[tuple[str, list[tuple[str, int]]]], dict[str, str], frozenset[str]]:
    """(code point -> parts with combining class), (pair -> composed), second halves of class 0."""
    everything = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    everything += [chr(i) for r in ((0x2F800, 0x2FA1E), (0xE0000, 0xE0080), (0xE0100, 0xE01F0)) for i in range(*r)]
    simple = {c: _wanted(c) for c in everything if not 0xAC00 <= ord(c) <= 0xD7A3}
    raised = ("<super>", "<sub>", "<circle>")
    letters = [c for c, d in simple.items() if d == c and unicodedata.category(c)[0] == "L" and c not in KEPT and not unicodedata.decomposition(c).startswith(raised) and not 0x1100 <= ord(c) <= 0x11FF]
    like = look_alikes(_skeletons(SparkSession.active(), letters))
    mapping = []
    for c, d in simple.items():
        to = "" if d is None else "".join(like.get(x, x) for x in d)
        if to != c or unicodedata.combining(c):
            mapping.append((c, [(x, unicodedata.combining(x)) for x in to]))
    pairs = {}
    for c in everything:
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
            pairs["".join(chr(int(x, 16)) for x in d.split())] = c
    second = frozenset(p[1] for p in pairs if not unicodedata.combining(p[1])) | {chr(i) for r in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for i in range(*r)}
    return mapping, pairs, second


def _plain(mapping: list, second: frozenset[str]) -> str:
    """A pattern for characters that are their own form: printable ASCII, Han and Hangul syllables without entries."""
    odd = {c for c, _ in mapping} | second
    ranges = [(0x21, 0x7E), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
    out = sorted(c for c in odd if any(a <= ord(c) <= b for a, b in ranges))
    inside = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    but = f"&&[^{''.join(f'\\x{{{ord(c):x}}}' for c in out)}]" if out else ""
    return f"[{inside}{but}]"


def _compose(marks: Column, pairs: dict[str, str]) -> Column:
    """Canonical composition of one run: array of (ccc, pos, sub, c) in order -> string."""
    known = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    at = lambda c: F.ascii(c)  # noqa: E731  ascii() is the code point of the first character
    bmp = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def step(s: Column, x: Column) -> Column:
        base, rest, last, c, k = s["base"], s["rest"], s["last"], x["c"], x["ccc"]
        b, v = at(base), at(c)
        # Hangul: lead + vowel, then syllable + tail, by arithmetic
        hangul = F.when(b.between(0x1100, 0x1112) & v.between(0x1161, 0x1175), bmp(((b - 0x1100) * 21 + v - 0x1161) * 28 + 0xAC00)).when(
            b.between(0xAC00, 0xD7A3) & ((b - 0xAC00) % 28 == 0) & v.between(0x11A8, 0x11C2), bmp(b + v - 0x11A7)
        )
        one = F.coalesce(hangul, F.try_element_at(known, F.concat(base, c)))
        free = (rest == "") | ((last < k) & (last > 0))  # nothing stands between it and the base that blocks it
        joined = F.when(free, one)
        return (
            F.when(base == "", F.struct(c.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last")))
            .when(joined.isNotNull(), F.struct(joined.alias("base"), rest.alias("rest"), last.alias("last")))
            .otherwise(F.struct(base.alias("base"), F.concat(rest, c).alias("rest"), k.alias("last")))
        )

    start = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    return F.aggregate(marks, start, step, lambda s: F.concat(s["base"], s["rest"]))


def text_forms(texts: DataFrame, column: str, plain: bool = True) -> DataFrame:
    """(text, form), one row for each distinct non-null value of ``texts[column]``.

    The empty text and texts of gaps or shapeless characters alone have the form ''. Forms have no gap at
    their ends and single blanks inside. Repeated texts are worked on once, so that no text is hot; a very
    long text takes a longer sort, not more rows in memory. An empty table gives an empty result; other
    columns are ignored.

    With ``plain``, texts without any entry of the table, and stretches without one, are not taken apart, as each of their
    characters is its own form whatever stands beside it; without it every code point is. The forms are the same.
    """
    spark = texts.sparkSession
    mapping, pairs, second = _tables(id(spark.sparkContext))
    kinds = T.StructType(
        [T.StructField("ch", T.StringType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("ccc", T.IntegerType())])))]
    )
    # About 10 000 rows by the rule above: a bound set by Unicode, not by the data.
    entries = spark.createDataFrame(mapping, kinds)

    key = F.unhex(F.md5(F.col("text"))).alias("key")
    one = _plain(mapping, second)
    whole = F.col("text").rlike(f"\\A[{one} ]*\\z") & ~F.col("text").rlike("\\A |  | \\z")
    once = texts.select(F.col(column).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    # Written once for all that reads it; the key here, below the explosion, or it would be made for every row of that.
    once = materialize(once.select("text", key, (whole if plain else F.lit(False)).alias("plain")), "texts")
    odd = once.where(~F.col("plain")).select("text", "key")

    # A stretch of plain characters keeps together, but for its last one, on which a mark may follow.
    stretch = F.regexp_extract_all("text", F.lit(f"({one}+(?={one})|[\\s\\S])" if plain else "([\\s\\S])"), F.lit(1))
    points = odd.select("key", F.posexplode(stretch).alias("pos", "ch"))
    points = points.join(F.broadcast(entries), "ch", "left").select(
        "key", "pos", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))).alias("sub", "part")
    )
    points = points.select("key", "pos", "sub", "part.c", "part.ccc")
    # A starter begins a block, within which marks are ordered by class; a run is what may compose into one.
    order = Window.partitionBy("key").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    tail = F.col("c").isin(*sorted(second))
    points = points.select(
        "key", "pos", "sub", "c", "ccc",
        F.sum((F.col("ccc") == 0).cast("int")).over(order).alias("block"),
        F.sum(((F.col("ccc") == 0) & ~tail).cast("int")).over(order).alias("run"),
    )
    runs = points.groupBy("key", "run").agg(F.sort_array(F.collect_list(F.struct("block", "ccc", "pos", "sub", "c"))).alias("marks"))
    runs = runs.select("key", "run", F.when(F.size("marks") == 1, F.col("marks")[0]["c"]).otherwise(_compose(F.col("marks"), pairs)).alias("c"))
    built = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("run", "c"))).alias("all"))
    built = built.select("key", F.trim(F.regexp_replace(F.array_join(F.col("all.c"), ""), " +", " ")).alias("form"))

    changed = odd.join(built, "key", "left").select("text", F.coalesce("form", F.lit("")).alias("form"))
    return once.where("plain").select("text", F.col("text").alias("form")).unionByName(changed)


def title_documents(goods: DataFrame) -> DataFrame:
    """(unique_id, title), one row for each document with a title.

    A document delivered more than once counts once; should its titles differ, the smallest holds. Rows
    with a null ``unique_id`` are no documents.
    """
    return goods.where(F.col("unique_id").isNotNull() & F.col("title").isNotNull()).groupBy("unique_id").agg(F.min("title").alias("title"))


def document_forms(goods: DataFrame) -> DataFrame:
    """(unique_id, title, form) of every document with a title."""
    docs = materialize(title_documents(goods), "titles")
    return docs.join(text_forms(docs, "title").withColumnRenamed("text", "title"), "title").select("unique_id", "title", "form")


def same_look_pairs(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """(unique_id_a, unique_id_b), a < b: documents with different titles of one form.

    ``forms`` has (text, form), ``docs`` (unique_id, title). Spellings of a form are paired first, each once, and documents
    only join pairs of spellings, so that documents with the very same title, however many, never meet.
    """
    spell = forms.select(F.unhex(F.md5(F.col("text"))).alias("t"), F.unhex(F.md5(F.col("form"))).alias("f"))
    several = spell.join(spell.groupBy("f").count().where("count > 1").select("f"), "f", "left_semi")
    pairs = several.alias("x").join(several.alias("y"), F.expr("x.f = y.f AND x.t < y.t")).select(F.col("x.t").alias("ta"), F.col("y.t").alias("tb"))
    members = docs.select("unique_id", F.unhex(F.md5(F.col("title"))).alias("t"))
    a, b = (members.select(F.col("t").alias(f"t{k}"), F.col("unique_id").alias(f"u{k}")) for k in "ab")
    met = pairs.join(a, "ta").join(b, "tb")
    return met.select(F.least("ua", "ub").alias("unique_id_a"), F.greatest("ua", "ub").alias("unique_id_b"))


def document_pairs(goods: DataFrame) -> DataFrame:
    """``same_look_pairs`` of the documents of a table."""
    docs = materialize(title_documents(goods), "titles")
    return same_look_pairs(materialize(text_forms(docs, "title"), "forms"), docs)


def form_links(goods: DataFrame) -> DataFrame:
    """(unique_id, class_id, links), one row for each document with a title: the smallest id with the same form, and the number
    of documents with that form whose title is another. Work and rows grow with the documents, not with pairs of them.
    """
    docs = materialize(title_documents(goods), "titles")
    by_title = docs.groupBy("title").agg(F.count("*").alias("own"), F.min("unique_id").alias("least"))
    spelled = by_title.join(text_forms(docs, "title").withColumnRenamed("text", "title"), "title")
    spelled = spelled.select(F.unhex(F.md5("title")).alias("t"), F.unhex(F.md5("form")).alias("f"), "own", "least")
    classes = spelled.groupBy("f").agg(F.sum("own").alias("all"), F.min("least").alias("class_id"))
    counted = spelled.join(classes, "f").select("t", "class_id", (F.col("all") - F.col("own")).alias("links"))
    return docs.select("unique_id", F.unhex(F.md5("title")).alias("t")).join(counted, "t").select("unique_id", "class_id", "links")


def form_classes(goods: DataFrame) -> DataFrame:
    """(unique_id, class_id, form): one row per document; ``class_id`` is the smallest id with that form."""
    forms = document_forms(goods)
    least = forms.groupBy("form").agg(F.min("unique_id").alias("class_id"))
    return forms.join(least, "form").select("unique_id", "class_id", "form")
