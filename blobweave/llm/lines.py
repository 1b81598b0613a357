"""Line dedup by a log-template tree: lines of templates that recur across documents are dropped.

Fixed-depth parsing: a line's leaf is its number of words and its first DEPTH
words, variable ones (those with a digit) as a wild card.  A leaf's template is
made of the words that CONSTANT_PERCENT of the leaf's lines have at a place, and a
wild card elsewhere; it counts if at least half of it is words, and a line fits if
it has them all.  Lines that don't fit are split by their word at the place that
varies least among those that vary, and each part may have a template in turn, LEVELS
times in all; so a leaf may hold several families of lines.  A line that fits
nowhere has its own template: the line with variable words as wild cards, or, where
more than half of its words are variable (tables, scores, dates), the line itself.

A template recurs if ``least_docs`` different texts hold it, so exact copies count
once.  Its lines stay in the document of smallest id, and in exact copies of that, and
go from all others.  Near copies are left to deduplication of documents: a document
keeps its lines if those that one other document holds first are at least
``copy_percent`` of the bytes of both.

Native: DataFrame functions only.  Counts combine before they are shuffled, also
those of distinct texts, so a line that half of all documents hold is no hot key.

Lines, leaves, templates and texts are told apart by 64-bit hashes.

Defined results: a null text has no lines and stays null; lines of fewer than
MIN_WORDS words are never dropped (the least that the method takes for boilerplate);
rows that repeat doc_id and text are treated alike; a null doc_id comes after all
others.  Other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import look_up, only, staged

DEPTH, MIN_WORDS, LEAST_DOCS, LEVELS = 3, 5, 3, 3
CONSTANT_PERCENT, COPY_PERCENT = 80, 80
WILD = "<*>"
#: White space within a line, where it is not single spaces.
_LOOSE = r"[\x09\x0B-\x0D]|\x20\x20|^\x20|\x20$|\n\x20|\x20\n"
#: A word with a digit: from a word's start, what is no digit, then the rest.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _normal(text: Column) -> Column:
    """``text`` with single spaces between the words of a line."""
    single = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r"(?dm)^\x20|\x20$", "")
    return F.when(text.rlike(_LOOSE), single).otherwise(text)


def parsed_lines(docs: DataFrame) -> DataFrame:
    """A row per line of at least MIN_WORDS words: doc_id, text_id, size (bytes of all lines), line (from 0), bytes, words, leaf, own,
    and masked: the line with wild cards, null if more than half of it is variable."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), _normal(F.col("text")).alias("normal"))
    texts = texts.select("doc_id", "text_id", (F.octet_length("normal") + 1).cast("long").alias("size"), "normal")
    lines = texts.select("doc_id", "text_id", "size", F.posexplode(F.split("normal", "\n")).alias("line", "plain"))
    words = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit(" "), F.lit(""))) + 1
    counted = lines.withColumn("words", words).where(F.col("words") >= MIN_WORDS)
    heavy = F.regexp_count("plain", F.lit(_VARIABLE)) * 2 > F.col("words")
    digits = F.col("plain").rlike("[0-9]")
    named = counted.withColumn("all", F.when(digits, F.regexp_replace("plain", _VARIABLE, WILD)).otherwise(F.col("plain")))
    named = named.withColumn("masked", F.when(digits & heavy, None).otherwise(F.col("all")))
    own = F.when(F.col("masked").isNull(), F.xxhash64(F.lit("plain"), "plain")).otherwise(F.xxhash64("masked"))
    leaf = F.xxhash64("words", F.substring_index("all", " ", DEPTH))
    return named.select("doc_id", "text_id", "size", "line", (F.octet_length("plain") + 1).cast("long").alias("bytes"), "words", leaf.alias("leaf"), own.alias("own"), "masked")


def leaf_templates(kinds: DataFrame) -> DataFrame:
    """(own, leaf, template) of the lines in ``kinds`` (leaf, words, masked, n) that fit a template of their leaf."""
    rest = kinds.select("leaf", "words", "masked", "n", F.col("leaf").alias("part"))
    found = []
    for level in range(LEVELS):
        met = rest.select("part", "words", "n", F.posexplode(F.split("masked", " ")).alias("place", "word"))
        places = met.groupBy("part", "words", "place", "word").agg(F.sum("n").alias("n"))
        best = places.groupBy("part", "words", "place").agg(F.sum("n").alias("all"), F.max(F.struct("n", "word")).alias("top"), F.count("*").alias("kinds"))
        common = F.col("top.n") * 100 >= F.col("all") * CONSTANT_PERCENT
        constant = F.when(common & (F.col("top.word") != WILD), F.struct("place", F.col("top.word").alias("word")))
        varies = F.when(~common, F.struct("kinds", "place"))
        by_part = best.groupBy("part", "words").agg(F.collect_list(constant).alias("constants"), F.min(varies)["place"].alias("split"))
        half = (F.size("constants") * 2 >= F.col("words")) & (F.size("constants") < F.col("words"))
        by_part = by_part.select("part", F.when(half, F.map_from_entries("constants")).alias("constants"), "split")
        fits = F.forall(F.map_entries("constants"), lambda e: F.element_at(F.col("_at"), e["key"] + 1) == e["value"])
        judged = rest.join(by_part, "part").withColumn("_at", F.split("masked", " ")).withColumn("_fits", F.coalesce(fits, F.lit(False)))
        judged = judged.select("leaf", "words", "masked", "n", "part", "_fits", F.element_at("_at", F.col("split") + 1).alias("word"))
        judged = staged(judged, "judged-lines") if level + 1 < LEVELS else judged  # the last is read once
        found.append(judged.where("_fits").select(F.xxhash64("masked").alias("own"), "leaf", F.xxhash64(F.lit("leaf"), "part").alias("template")))
        rest = judged.where("NOT _fits AND word IS NOT NULL").select("leaf", "words", "masked", "n", F.xxhash64("part", F.lit(level), "word").alias("part"))
    return reduce(DataFrame.unionByName, found)


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, copy_percent: int | None = COPY_PERCENT) -> DataFrame:
    """doc_id, text_id, lines (places of the recurring lines that other documents hold first) and copy (whether it is one)."""
    slim = staged(parsed_lines(docs), "lines")
    texts = F.count_distinct("text_id").alias("texts")
    leaves = slim.where("masked IS NOT NULL").groupBy("leaf").agg(texts, F.min("own").alias("a"), F.max("own").alias("b"))
    open_leaves = staged(leaves.where((F.col("texts") >= least_docs) & (F.col("a") != F.col("b"))).select("leaf"), "leaves")
    # the distinct lines of those leaves, with their number
    met = only(slim.where("masked IS NOT NULL").select("leaf", "words", "masked"), open_leaves, "leaf")
    kinds = staged(met.groupBy("leaf", "words", "masked").agg(F.count("*").alias("n")), "kinds")
    sizes = slim.groupBy("own", "leaf").agg(F.count("*").alias("_n"))
    # lines that keep their own template are most; they need no lookup
    changed = staged(sizes.join(leaf_templates(kinds), ["own", "leaf"]).select("own", "_n", "template"), "changed")
    looked = look_up(slim.select("doc_id", "text_id", "size", "line", "bytes", "own"), changed, "own", "_n")
    lines = looked.withColumn("template", F.coalesce("template", F.xxhash64(F.lit("own"), "own"))).drop("own")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "size", "text_id")).alias("_first")
    found = staged(lines.groupBy("template").agg(texts, first, F.count("*").alias("_n")).where(F.col("texts") >= least_docs).select("template", "_first", "_n"), "recurring")
    met = look_up(lines, found, "template", "_n").where("_first IS NOT NULL")
    later = met.where(~F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("text_id") != F.col("_first.text_id")))
    shared = later.groupBy("doc_id", "text_id", "size", "_first").agg(F.collect_set(F.struct("line", "bytes")).alias("lines"))
    shared = shared.withColumn("shared", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["bytes"]))
    copy = F.lit(False) if copy_percent is None else F.col("shared") * 100 >= F.greatest("size", "_first.size") * copy_percent
    return shared.groupBy("doc_id", "text_id").agg(F.array_sort(F.flatten(F.collect_list("lines.line"))).alias("lines"), F.max(copy).alias("copy"))


def without_recurring(docs: DataFrame, least_docs: int = LEAST_DOCS, copy_percent: int | None = COPY_PERCENT) -> DataFrame:
    """``docs`` (doc_id, text) with recurring (places of lines, null if none), copy and kept (the text left)."""
    found = recurring_lines(docs, least_docs, copy_percent)
    # a byte for each line up to the last recurring one: 1 if it goes
    gaps = F.transform(F.arrays_zip(F.col("lines").alias("at"), F.concat(F.array(F.lit(-1)), F.col("lines")).alias("before")), lambda z: F.when(z["at"].isNotNull(), F.concat(F.repeat(F.lit("0"), z["at"] - z["before"] - 1), F.lit("1"))))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), F.col("lines").alias("recurring"), "copy", F.encode(F.array_join(gaps, ""), "UTF-8").alias("_mask"))
    found = staged(found, "recurring-lines")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_id"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    met = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_d"]) & (keyed["_id"] == found["_t"]), "left")
    lines = F.filter(F.split("text", "\n"), lambda _, i: F.substring(F.col("_mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col("_mask").isNull() | F.col("copy"), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return met.withColumn("kept", text).drop("_id", "_d", "_t", "_mask")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = without_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    recurring = F.coalesce(F.size("recurring"), F.lit(0)).cast("long")
    dropped = F.when(F.col("copy"), F.lit(0).cast("long")).otherwise(recurring)
    return docs.select("doc_id", n.alias("n_lines"), recurring.alias("n_recurring"), dropped.alias("n_dropped"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; other columns as they are, ``n_chars`` counted anew if there."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # other columns may have any name
    done = without_recurring(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()]))
    chars = F.coalesce(F.length("kept"), F.lit(0))
    return done.select(*[F.col("kept").alias(c) if c == "text" else chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(names.get(c, c)).alias(c) for c in docs.columns])


_LEVEL_SQL = """
met{k} AS (SELECT part, words, n, unnest(masked) AS word, generate_subscripts(masked, 1) AS place FROM rest{k}),
places{k} AS (SELECT part, words, place, word, sum(n) AS n FROM met{k} GROUP BY ALL),
best{k} AS (SELECT part, words, place, sum(n) AS total, max(n) AS most, max_by(word, n) AS word, count(*) AS kinds FROM places{k} GROUP BY ALL),
constants{k} AS (SELECT part, place, word FROM best{k} WHERE most * 100 >= total * 80 AND word <> '<*>'),
split{k} AS (SELECT part, min_by(place, kinds * 1000000 + place) AS place FROM best{k} WHERE most * 100 < total * 80 GROUP BY part),
templates{k} AS (SELECT part, count(*) AS size FROM constants{k} JOIN (SELECT DISTINCT part, words FROM best{k}) USING (part) GROUP BY part, words HAVING count(*) * 2 >= words AND count(*) < words),
fitting{k} AS (
  SELECT r.leaf, r.own, r.part FROM rest{k} r JOIN constants{k} c USING (part) JOIN templates{k} t USING (part)
  GROUP BY r.leaf, r.own, r.part, t.size HAVING count(CASE WHEN r.masked[c.place] = c.word THEN 1 END) = t.size),
rest{next} AS (
  SELECT r.leaf, r.words, r.own, r.masked, r.n, r.part || chr(10) || s.place || ' ' || r.masked[s.place] AS part FROM rest{k} r JOIN split{k} s USING (part)
  ANTI JOIN fitting{k} f USING (leaf, own)),"""
OP8_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
words AS (SELECT doc_id, text, line, value, regexp_extract_all(value, '[^\\x20\\x09-\\x0D]+') AS list FROM lines),
measured AS (
  SELECT doc_id, text, line, list, array_to_string(list, ' ') AS plain, len(list) AS words, strlen(array_to_string(list, ' ')) + 1 AS bytes,
    list_transform(list, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS masked,
    len(list_filter(list, lambda t: regexp_matches(t, '[0-9]'))) * 2 > len(list) AS heavy FROM words),
sized AS (SELECT doc_id, text, max(size) AS size FROM (SELECT doc_id, text, line, bytes, sum(bytes) OVER (PARTITION BY doc_id, text) AS size FROM (SELECT DISTINCT doc_id, text, line, bytes FROM measured)) GROUP BY ALL),
parsed AS (
  SELECT *, CASE WHEN heavy THEN 'plain ' || plain ELSE 'masked ' || array_to_string(masked, ' ') END AS own,
    words || ' ' || array_to_string(masked[1:3], ' ') AS leaf FROM measured WHERE words >= 5),
open_leaves AS (SELECT leaf FROM parsed WHERE NOT heavy GROUP BY leaf HAVING count(DISTINCT text) >= 3 AND min(own) <> max(own)),
rest0 AS (SELECT leaf, words, own, masked, count(*) AS n, leaf AS part FROM parsed JOIN open_leaves USING (leaf) WHERE NOT heavy GROUP BY ALL),""" + "".join(_LEVEL_SQL.format(k=k, next=k + 1) for k in range(LEVELS)) + """
fitting AS (""" + " UNION ALL ".join(f"SELECT leaf, own, 'leaf ' || part AS template FROM fitting{k}" for k in range(LEVELS)) + """),
templated AS (
  SELECT p.doc_id, p.text, p.line, p.bytes, s.size, coalesce(f.template, 'own ' || p.own) AS template
  FROM parsed p LEFT JOIN fitting f ON f.own = p.own AND f.leaf = p.leaf JOIN sized s ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.text = p.text),
recurring AS (SELECT template, min(doc_id) AS first_id FROM templated GROUP BY template HAVING count(DISTINCT text) >= 3),
first_sizes AS (SELECT r.template, r.first_id, min(t.size) AS first_size, min_by(t.text, t.size) AS first_text FROM recurring r JOIN templated t ON t.template = r.template AND t.doc_id IS NOT DISTINCT FROM r.first_id GROUP BY ALL),
later AS (SELECT DISTINCT t.doc_id, t.text, t.line, t.bytes, t.size, r.first_id, r.first_size, r.first_text FROM templated t JOIN first_sizes r USING (template) WHERE t.doc_id IS DISTINCT FROM r.first_id AND t.text <> r.first_text),
copies AS (
  SELECT doc_id, text, bool_or(copy) AS copy, sum(n) AS n FROM (
    SELECT doc_id, text, count(*) AS n, sum(bytes) * 100 >= greatest(size, first_size) * 80 AS copy FROM later GROUP BY doc_id, text, size, first_id, first_size, first_text) GROUP BY ALL),
left_over AS (
  SELECT j.doc_id, j.text, string_agg(j.value, chr(10) ORDER BY j.line) AS kept
  FROM (SELECT DISTINCT doc_id, text, line, value FROM lines) j LEFT JOIN later l ON l.doc_id IS NOT DISTINCT FROM j.doc_id AND l.text = j.text AND l.line = j.line
  WHERE l.line IS NULL GROUP BY j.doc_id, j.text)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_recurring,
  CAST(CASE WHEN c.copy THEN 0 ELSE coalesce(c.n, 0) END AS BIGINT) AS n_dropped,
  sha256(CASE WHEN c.n > 0 AND NOT c.copy THEN coalesce(k.kept, '') ELSE coalesce(d.text, '') END) AS kept_sha256
FROM documents d LEFT JOIN copies c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text = d.text LEFT JOIN left_over k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.text = d.text
"""
