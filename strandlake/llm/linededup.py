"""Operator 10: line deduplication within an edit bound, by deletion neighbourhoods.

A line (``\\n``-separated) is dropped if an earlier line, in the order of (identifier, line
number), equals it, or if both have ``min_chars`` code points at least and the earlier one is
at most ``edits`` insertions, deletions or substitutions away.  Lines of fewer than
``equal_chars`` code points or of white space alone always stay.

All steps are DataFrame functions.  (1) Equal lines meet by a 128-bit hash; their first place
is a map-side combined minimum.  (2) For a bound of one: two lines within it agree in all but
one quarter, so each line emits the hashes of its text without one quarter, once for its own
length and once for a partner shorter by one; only lines that meet a different line there go on.
(3) These emit all their deletion variants inside the open quarter as hashed keys: with the
place of the deletion (equal: a substitution) and without (equal to a whole shorter line:
an insertion).  For a larger bound every line emits all variants of up to so many deletions,
each deletion marked as half of a substitution (its place is part of the key) or as a letter
that the partner lacks, with the number that the partner must delete.  So lines that share a
key are within the bound, and (4) every key group is reduced to its earliest line, which is
joined back: no pairs are made, and none is lost.  (5) The edit distance is verified.  Keys are 128
bits, so that a foreign line practically never hides a partner.

Special cases: null texts have no lines; empty tables give empty results; a null identifier
comes first; rows with one identifier are one place in the order, so they never drop each
other's line of the same number; ties and repeated rows are treated alike; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, small, text_hash


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def split_lines(docs: DataFrame, equal_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, line_no`` (from 0), ``line`` of all lines of ``equal_chars`` code points with something other than white space."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return rows.filter((F.length("line") >= equal_chars) & F.col("line").rlike(r"\S"))


def _quarter(m: Column, k: int) -> Column:
    """Where quarter k of m code points begins."""
    return (m * k / 4).cast("int")


def _with_quarter_keys(lines: DataFrame) -> DataFrame:
    """``line, h1, h2, key, role, t``: each line without quarter t, for its own and the shorter length.

    ``role`` 0: a partner of the same length or longer by one is sought; 1: shorter by one.
    The quarters are hashed once each - behind an open quarter of the shorter length a
    place later - and a key combines the hashes of three.
    """
    n = F.length("line")

    def hashed(m: Column, k: int, shift: int) -> Column:
        return F.xxhash64(F.substring("line", _quarter(m, k) + 1 + shift, _quarter(m, k + 1) - _quarter(m, k)))

    own = [hashed(n, k, 0).alias(f"own{k}") for k in range(4)]
    before = [hashed(n - 1, k, 0).alias(f"before{k}") for k in range(3)]
    behind = [hashed(n - 1, k, 1).alias(f"behind{k}") for k in (1, 2, 3)]
    parts = lines.select("line", *_hashes(F.col("line")), n.alias("n"), *own, *before, *behind)
    names = {0: lambda t, k: f"own{k}", 1: lambda t, k: f"before{k}" if k < t else f"behind{k}"}
    keys = [F.struct(F.xxhash64(F.lit(t), F.col("n") - role, *[F.col(names[role](t, k)) for k in range(4) if k != t]).alias("key"), F.lit(role).alias("role"), F.lit(t).alias("t")) for role in (0, 1) for t in range(4)]
    return parts.select("line", "h1", "h2", F.explode(F.array(*keys)).alias("k")).select("line", "h1", "h2", "k.key", "k.role", "k.t")


#: Sides of a key and the side of the partner: both halves of a substitution; a longer line without a letter and a whole shorter one.
_PARTNER = "CASE side WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"


def _one_edit(lines: DataFrame, firsts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts ``h1, h2, line``, keys ``h1, h2, first, side, partner, v1, v2``) of the lines that meet another in all but a quarter."""
    with_keys = _with_quarter_keys(lines)
    met = with_keys.select("h1", "key").groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    met = scratch.stage(met, "lines-met")
    asked = with_keys.join(small(met), "key", "left_semi").groupBy("key", "h1", "h2", "role", "t").agg(F.first("line").alias("line"))
    m = F.length("line") - F.col("role")
    head = reduce(lambda rest, t: F.when(F.col("t") == t, _quarter(m, t)).otherwise(rest), range(3), _quarter(m, 3))
    tail = reduce(lambda rest, t: F.when(F.col("t") == t, m - _quarter(m, t + 1)).otherwise(rest), range(3), F.lit(0))
    asked = scratch.stage(asked.select("key", "h1", "h2", "role", head.alias("head"), tail.alias("tail"), "line"), "lines-asked")
    here = asked.join(small(firsts.select("h1", "h2", "first"), of=firsts), ["h1", "h2"])
    here = here.withColumn("mid", F.expr("substring(line, head + 1, length(line) - head - tail)"))
    two = lambda *c: [F.xxhash64(*c).alias("v1"), F.xxhash64(F.lit(1), *c).alias("v2")]
    hole = "transform(sequence(1, length(mid)), i -> struct(i as at, concat(left(mid, i - 1), substring(mid, i + 1)) as z))"
    holes = here.filter("length(mid) > 0").select("h1", "h2", "first", "role", "key", F.explode(F.expr(hole)).alias("d")).select("h1", "h2", "first", "role", "key", "d.at", "d.z")
    same = holes.filter("role = 0").select("h1", "h2", "first", F.lit(0).alias("side"), *two("key", "z", "at"))
    long_ = holes.filter("role = 1").select("h1", "h2", "first", F.lit(1).alias("side"), *two("key", "z")).distinct()
    short = here.filter("role = 0").select("h1", "h2", "first", F.lit(2).alias("side"), *two("key", "mid"))
    keys = same.unionByName(long_).unionByName(short).withColumn("partner", F.expr(_PARTNER))
    return asked.groupBy("h1", "h2").agg(F.first("line").alias("line")), scratch.stage(keys, "lines-variants")


def _many_edits(lines: DataFrame, firsts: DataFrame, edits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The same for any bound: about (2 n)^edits / edits! keys for a line of n letters."""
    texts = scratch.stage(lines.select("line", *_hashes(F.col("line"))).groupBy("h1", "h2").agg(F.first("line").alias("line")), "lines-asked")
    # z: the text without some letters; subs: places of halves of substitutions in it; low: where the next deletion may be
    step = texts.join(small(firsts.select("h1", "h2", "first"), of=firsts), ["h1", "h2"])
    step = step.select("h1", "h2", "first", F.col("line").alias("z"), F.array().cast("array<int>").alias("subs"), F.lit(0).alias("dels"), F.lit(0).alias("low"))
    every = step
    for _ in range(edits):
        cut = step.filter("low < length(z)").withColumn("at", F.explode(F.expr("sequence(low, length(z) - 1)"))).withColumn("is_sub", F.explode(F.array(F.lit(0), F.lit(1))))
        z = F.expr("concat(left(z, at), substring(z, at + 2))")
        subs = F.when(F.col("is_sub") == 1, F.concat("subs", F.array("at"))).otherwise(F.col("subs"))
        step = cut.select("h1", "h2", "first", z.alias("z"), subs.alias("subs"), (F.col("dels") + 1 - F.col("is_sub")).alias("dels"), F.col("at").alias("low")).distinct()
        every = every.unionByName(step)
    left = F.lit(edits) - F.size("subs") - F.col("dels")
    keys = every.withColumn("theirs", F.explode(F.sequence(F.lit(0), left)))
    side, partner = F.col("dels") * (edits + 1) + F.col("theirs"), F.col("theirs") * (edits + 1) + F.col("dels")
    key = [F.xxhash64("z", "subs").alias("v1"), F.xxhash64(F.lit(1), "z", "subs").alias("v2")]
    return texts, scratch.stage(keys.select("h1", "h2", "first", side.alias("side"), partner.alias("partner"), *key).distinct(), "lines-variants")


def find_first_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", equal_chars: int | None = None, edits: int = 1) -> DataFrame:
    """The lines to drop: ``doc_id, text_hash, line_no, first_doc_id, first_line_no, edits``.

    ``first_*`` is the earliest line within the bound, ``edits`` the distance to it.  Lines of
    ``equal_chars`` code points (``min_chars`` if not given) are compared for equality, those of ``min_chars`` within ``edits``.
    """
    scratch = Scratch(docs.sparkSession)
    every = split_lines(docs, min_chars if equal_chars is None else min(equal_chars, min_chars), id_col, text_col)
    lines = every.filter(F.length("line") >= min_chars)
    place = F.struct("doc_id", "line_no")
    hashed = every.select("doc_id", "text_hash", "line_no", *_hashes(F.col("line")))
    firsts = scratch.stage(hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "lines-first")
    known = firsts.withColumn("near", F.lit(None).cast(firsts.schema["first"].dataType)).withColumn("distance", F.lit(0))
    if edits:
        texts, variants = _one_edit(lines, firsts, scratch) if edits == 1 else _many_edits(lines, firsts, edits, scratch)
        # (4) the earliest line of each key and side; a line asks for the partner's side
        least = scratch.stage(variants.groupBy("v1", "v2", "side").agg(F.min(F.struct("first", "h1", "h2")).alias("m")), "lines-least")
        asks = variants.select("h1", "h2", "first", "v1", "v2", F.col("partner").alias("side"))
        pairs = asks.join(small(least), ["v1", "v2", "side"]).filter("m.first < first").groupBy("h1", "h2").agg(F.min("m").alias("m"))
        pairs = scratch.stage(pairs.select("h1", "h2", F.col("m.first").alias("near"), F.col("m.h1").alias("p1"), F.col("m.h2").alias("p2")), "lines-pairs")
        # (5) verified on the texts
        partner = texts.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("other"))
        near = pairs.join(texts, ["h1", "h2"]).join(partner, ["p1", "p2"]).withColumn("distance", F.expr(f"levenshtein(line, other, {edits})"))
        near = scratch.stage(near.filter("distance > 0").select("h1", "h2", "near", "distance"), "lines-near")
        known = firsts.join(small(near), ["h1", "h2"], "left")
    better = F.coalesce(F.col("near") < F.col("first"), F.lit(False))
    known = known.filter("n > 1 or near is not null").select("h1", "h2", F.when(better, F.col("near")).otherwise(F.col("first")).alias("first"), F.when(better, F.col("distance")).otherwise(0).alias("edits"))
    known = scratch.stage(known, "lines-known")
    scratch.drop(known)
    found = hashed.join(small(known), ["h1", "h2"]).filter(F.col("first") < place)
    return found.select("doc_id", "text_hash", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), "edits")


def drop_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines in ``dropped`` (``doc_id, text_hash, line_no``); all columns stay.

    Texts that lose no line are untouched; a text that loses all becomes empty.
    """
    gone = dropped.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_set("line_no")).alias("__gone"))
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash(F.col(text_col)) == F.col("__hash")), "left")
    lines = f"array(named_struct('x', split(`{text_col}`, '\n', -1), 'gone', __gone))"  # bound once, not per line
    kept = F.expr(f"transform({lines}, s -> array_join(transform(array_except(sequence(0, size(s.x) - 1), s.gone), i -> s.x[i]), '\n'))[0]")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    out = out.withColumn(text_col, text)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col("__gone").isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)

