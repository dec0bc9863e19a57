"""Removal of repeated lines, exact or within one word's edit, by a deletion-neighbourhood join.

Distance counts words put in, left out or changed in a line; the bound is one. A line goes
if an earlier line (by doc_id, then place) equals it or lies within the bound. Only
DataFrame functions are used.

1. Equal lines collapse to one class with its earliest occurrence.
2. Two lines within the bound share their first or their last half, so halves are counted
   by hash first; only lines that share one go on, with that half named.
3. These emit their variants within the other half as hashed keys: the line without its
   ith word (for a changed word), and the same against whole lines split at i (for a
   word put in or left out). Equal keys are joined with the key's earliest line, so a group of
   n gives n rows and no pairs.
4. The distance to that earliest line is verified on the words themselves.

Lines are trimmed of spaces and cut into words at single spaces. Lines of fewer than five
words are too short to tell a near copy from chance. With short=True, as in the pipeline, they
go where they equal an earlier line, blank ones apart; without, as in the query and its SQL,
they stay and remove nothing.

Defined cases: null text stays null, empty text empty; very long lines are taken whole;
rows that repeat in doc_id and text are one document and come back each; a null doc_id
counts as the last; other columns pass through, but for n_lines, n_removed and emptied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import materialize, quoted, table

MIN_WORDS = 5
_LAST = 2**63 - 1


def _words_in(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with what tells them apart: ord and dkey."""
    return docs.withColumns({"ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "dkey": F.xxhash64("text")})


def _judged(line: Column, short: bool) -> Column:
    enough = _words_in(line) >= MIN_WORDS
    return enough | line.rlike(r"\S") if short else enough


def _lines(docs: DataFrame, short: bool) -> DataFrame:
    """(ord, dkey, pos, line, n, h1, h2) of all lines that are judged: long enough or, if short, not blank."""
    rows = _keyed(docs.select("doc_id", "text")).select("ord", "dkey", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    rows = rows.withColumn("n", _words_in(F.col("line"))).where(_judged(F.col("line"), short))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _half_keys(n: Column, as_long: int) -> list[Column]:
    """Hashes of the first and the last half, as of a line of n - as_long words."""
    m = n - as_long
    h = _half(m)
    first = F.call_function("substring_index", F.col("line"), F.lit(" "), h)
    last = F.call_function("substring_index", F.col("line"), F.lit(" "), h - m)
    keys = [F.xxhash64(m, F.lit(side), part) for side, part in (("p", first), ("s", last))]
    return [F.when(m >= MIN_WORDS, k) for k in keys]


def _classes(docs: DataFrame, short: bool) -> DataFrame:
    """One row for each different line: its earliest place f, how often it occurs, its half keys (null for short lines)."""
    rows = _lines(docs, short)
    keys = [k.alias(f"k{i}") for i, k in enumerate(_half_keys(F.col("n"), 0) + _half_keys(F.col("n"), 1))]
    rows = rows.select("h1", "h2", F.struct("ord", "dkey", "pos").alias("f"), "n", *keys)
    return rows.groupBy("h1", "h2").agg(F.min("f").alias("f"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")])


def _suspects(classes: DataFrame) -> DataFrame:
    """(h1, h2, f, n, wants): lines that share a half with another; wants: (side, role, sub, ins)."""
    entry = [F.struct(F.col(f"k{i}").alias("key"), F.lit("ps"[i % 2]).alias("side"), F.lit(i // 2).alias("role")) for i in range(4)]
    keyed = classes.select("h1", "h2", "f", "n", F.explode(F.array(*entry)).alias("e")).select("h1", "h2", "f", "n", "e.*").where(F.col("key").isNotNull())
    counts = keyed.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("own"), F.count_if(F.col("role") == 1).alias("longer"))
    counts = counts.where((F.col("own") > 1) | ((F.col("own") > 0) & (F.col("longer") > 0)))
    met = keyed.join(counts, "key")
    want = F.struct("side", "role", ((F.col("role") == 0) & (F.col("own") > 1)).alias("sub"), ((F.col("own") > 0) & (F.col("longer") > 0)).alias("ins"))
    met = met.withColumn("want", want).where(F.col("want.sub") | F.col("want.ins"))
    return met.groupBy("h1", "h2", "f", "n").agg(F.collect_set("want").alias("wants"))  # four at most


def _with_text(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """The suspects' lines, from their earliest place."""
    by_doc = suspects.groupBy(F.col("f.ord").alias("ord"), F.col("f.dkey").alias("dkey")).agg(F.collect_list(F.struct("h1", "h2", "f", "n", "wants")).alias("all"))
    texts = _keyed(docs.select("doc_id", "text")).select("ord", "dkey", "text").where(F.col("text").isNotNull())
    rows = texts.join(by_doc, ["ord", "dkey"]).withColumn("lines", F.split("text", "\n"))
    line = F.col("lines")[F.col("one.f.pos")]
    rows = rows.select("lines", F.explode("all").alias("one")).select("one.*", F.split(F.trim(line), " ").alias("words"))
    return rows.dropDuplicates(["h1", "h2"])


def _prefix(hashes: Column) -> Column:
    """All running combinations of the hashes, the empty one first."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(hashes, start, lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, kind, f): S a line without a word, for lines as long; D the same, for lines shorter by one; W whole lines, for lines longer by one."""
    n = F.col("n")
    front = _prefix(F.transform("words", lambda w, i: F.xxhash64(w, i)))
    back = F.reverse(_prefix(F.transform(F.reverse("words"), lambda w, i: F.xxhash64(w, i, F.lit("b")))))
    rows = lines.withColumns({"front": front, "back": back}).select("f", "n", "front", "back", F.explode("wants").alias("want")).select("f", "n", "front", "back", "want.*")
    h = _half(F.when(F.col("role") == 0, n).otherwise(n - 1))

    def places(upto: Column) -> Column:
        return F.when(F.col("side") == "p", F.sequence(h, upto)).otherwise(F.sequence(F.lit(0), h - 1))

    def at(i: Column, kind: str, length: Column, after: int) -> Column:
        tag = "S" if kind == "S" else "I"
        return F.struct(F.xxhash64(F.lit(tag), length, i, F.col("front")[i], F.col("back")[i + after]).alias("key"), F.lit(kind).alias("kind"))

    none = F.array().cast("array<struct<key:bigint,kind:string>>")
    subs = F.when(F.col("sub"), F.transform(places(n - 1), lambda i: at(i, "S", n, 1))).otherwise(none)
    whole = F.when(F.col("ins") & (F.col("role") == 0), F.transform(places(n), lambda i: at(i, "W", n, 0))).otherwise(none)
    less = F.when(F.col("ins") & (F.col("role") == 1), F.transform(places(n - 1), lambda i: at(i, "D", n - 1, 1))).otherwise(none)
    return rows.select("f", F.explode(F.concat(subs, whole, less)).alias("v")).select("f", "v.*")


def _within_one(a: Column, b: Column) -> Column:
    """Whether two lists of words differ by at most one word changed, put in or left out."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    differ = F.zip_with(short, F.slice(long_, 1, F.size(short)), lambda x, y: x != y)
    first = F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)), F.size(short).cast("long") + 1).cast("int")  # from 1
    rest = F.slice(long_, first + 1, F.size(long_))
    same = F.slice(short, F.when(F.size(a) == F.size(b), first + 1).otherwise(first), F.size(short))
    return (F.size(long_) - F.size(short) <= 1) & (rest == same)


def _near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(f): different lines with an earlier line within the bound."""
    lines = materialize(_with_text(docs, materialize(_suspects(classes))))
    keyed = materialize(_variants(lines))
    first = keyed.groupBy("key").agg(F.min(F.when(F.col("kind") != "D", F.col("f"))).alias("whole"), F.min(F.when(F.col("kind") == "D", F.col("f"))).alias("less"))
    first = first.where(F.col("less").isNotNull() | F.col("whole").isNotNull())
    met = keyed.join(first, "key").withColumn("e", F.when(F.col("kind") == "W", F.col("less")).otherwise(F.col("whole")))
    pairs = met.where(F.col("e") < F.col("f")).select("f", "e").distinct()
    text = lines.select("f", "words")
    both = pairs.join(text.select(F.col("f").alias("e"), F.col("words").alias("a")), "e").join(text.withColumnRenamed("words", "b"), "f")
    return both.where(_within_one(F.col("a"), F.col("b"))).select("f").distinct()


def line_dedup(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) without repeated lines; adds n_lines, n_removed and emptied (every line that is judged is gone).

    short: exact repeats of lines below MIN_WORDS go too.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    # columns that are not needed go in one struct, so their names cannot clash with working ones
    others = [c for c in names if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *([F.struct(*[F.col(quoted(c)).alias(c) for c in others]).alias("_others")] if others else []))
    classes = materialize(_classes(docs, short))
    near = _near_lines(docs, classes)
    # lines that occur once and are near no other need no further look
    again = classes.where(F.col("times") > 1).select("h1", "h2", "f", F.lit(False).alias("near"))
    near = classes.select("h1", "h2", "f").join(near, "f", "left_semi").select("h1", "h2", "f", F.lit(True).alias("near"))
    rule = materialize(again.unionAll(near).groupBy("h1", "h2").agg(F.first("f").alias("f"), F.bool_or("near").alias("near")))
    place = F.struct("ord", "dkey", "pos")
    gone = _lines(docs, short).select("ord", "dkey", "pos", "h1", "h2").join(rule, ["h1", "h2"]).where(F.col("near") | (place != F.col("f")))
    gone = materialize(gone.groupBy("ord", "dkey").agg(F.collect_set("pos").alias("gone")))

    lines = F.split("text", "\n")
    out = _keyed(docs).join(gone, ["ord", "dkey"], "left").withColumn("_lines", lines)
    n = F.coalesce(F.size("_lines"), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n"))
    judged = F.size(F.filter("_lines", lambda x: _judged(F.trim(x), short)))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    added = {"n_lines": n.cast("long"), "n_removed": removed.cast("long"), "emptied": F.col("gone").isNotNull() & (judged == F.size("gone"))}
    given = {"doc_id": F.col("doc_id"), "text": text}
    return out.select(*[given[c].alias(c) if c in given else F.col("_others").getField(c).alias(c) for c in names], *[v.alias(k) for k, v in added.items()])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines of any length go; so do documents of which no line that is not blank is left."""
    own = docs.select([F.col(quoted(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")])
    out = line_dedup(own, short=True)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*map(quoted, own.columns))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH a AS (SELECT doc_id, str_split(text, chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM a),
l AS (SELECT doc_id, pos, trim(ls[pos], ' ') AS line, str_split(trim(ls[pos], ' '), ' ') AS w FROM o),
j AS (SELECT * FROM l WHERE len(w) >= {MIN_WORDS}),
c AS (SELECT line, any_value(w) AS w, min({{'d': doc_id, 'p': pos}}) AS f FROM j GROUP BY line),
v AS (SELECT line, f, len(w) AS n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:len(w)]), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c)),
near AS (SELECT y.line FROM v x JOIN v y ON x.n = y.n AND x.i = y.i AND x.s = y.s WHERE x.f < y.f
         UNION SELECT CASE WHEN c.f < v.f THEN v.line ELSE c.line END FROM v JOIN c ON v.s = c.line),
g AS (SELECT j.doc_id, j.pos FROM j JOIN c ON j.line = c.line WHERE {{'d': j.doc_id, 'p': j.pos}} <> c.f OR j.line IN (SELECT line FROM near)),
k AS (SELECT o.doc_id, o.pos, o.ls[o.pos] AS line, g.pos IS NOT NULL AS gone, j.pos IS NOT NULL AS judged
      FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.pos = g.pos LEFT JOIN j ON o.doc_id = j.doc_id AND o.pos = j.pos)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone) > 0 AND bool_and(gone OR NOT judged) AS emptied
FROM k GROUP BY doc_id"""
}
