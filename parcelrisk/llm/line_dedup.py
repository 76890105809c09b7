"""Line dedup with content-defined chunks, in DataFrame functions only.

A text is cut into lines: at newlines, and inside paragraphs at sentence ends; stretches of more than 200 characters without sentence end
are cut where their content says so, so that these cuts do not depend on where a stretch begins either, and after 400 characters where it does not. A rolling hash over the hashes of two lines decides
where boundaries lie, so the same lines are cut alike wherever they stand. Chunks run from one boundary to the next; so that the ends of
a repeated passage are found too, the shortest chunk of several lines that begins or ends at each boundary counts as well. Chunks that
occur more than once in the corpus are candidates; their bytes are compared, and all but the first occurrence (by doc_id, then place)
are cut out of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch

WIDE = "。！？"
#: A stretch without sentence end may be cut after a space behind a word whose last or last but one letter is one of these, or after one of
#: these characters of scripts without spaces: some of each script, in few ranges, as each character is held against all of them.
LETTERS = "37gkmxz" + "à-åа-гα-γا-ثא-ג"
UNSPACED = "ก-ฆむ-ん一-儿干-彿火-焿言-访아-안"


def _pattern(end: str) -> str:
    """A sentence of up to 200 characters; of a longer stretch the piece up to its first cut after 40 characters, or its first 400 characters if they hold none."""
    rest = rf"[^{end}\n]"
    return rf"{rest}{{1,200}}(?:[{end}]+ *\n?|\n|$)|{rest}{{40,400}}?(?:[{LETTERS}]{rest}? |[{UNSPACED}])|{rest}{{1,400}}(?:[{end}]+ *\n?|\n)?|[{end}]+ *\n?|\n"


def _in_spark(pattern: str) -> Column:
    """The same for Java, whose ``$`` also stands before a last carriage return; what a sentence took is not given back, as no shorter piece ends where one may end."""
    return F.lit(pattern.replace("$", r"\z").replace("{1,200}", "{1,200}+"))


LINE, NARROW_LINE = _pattern(".!?" + WIDE), _pattern(".!?")
BLANK = r" \n"
HOT_CHUNKS = 10_000


def _keys(doc_id: Column, text: Column) -> list[Column]:
    """k1, k2 name a row: rows of one id with different texts stay apart, also where the id is null."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(doc_id, text).alias("k2")]


def _lines(text: str = "text") -> Column:
    """The lines of a text. The pattern without wide sentence ends is several times faster, and the same where there are none."""
    t = F.col(text)
    wide = (F.octet_length(t) > F.length(t)) & (F.contains(t, F.lit(WIDE[0])) | F.contains(t, F.lit(WIDE[1])) | F.contains(t, F.lit(WIDE[2])))
    return F.when(wide, F.regexp_extract_all(F.col(text), _in_spark(LINE), F.lit(0))).otherwise(F.regexp_extract_all(F.col(text), _in_spark(NARROW_LINE), F.lit(0)))


def _bare(x: str) -> str:
    """A line or chunk without spaces and newlines at the end. Trimming of a set looks at every character, that of spaces at the last ones only, and mostly does."""
    return f"IF(endswith(rtrim({x}), '{BLANK[1:]}'), trim(TRAILING '{BLANK}' FROM {x}), rtrim({x}))"


def _shortest(at: str, step: int, most: str, least_chars: int) -> str:
    """Least number of lines, two at least, that hold ``least_chars`` characters from line ``at`` on (step 1) or up to it (step -1).

    Few lines are tried one by one, then a fold goes over the next dozen and, where these do not do, one over as many lines as can be needed.
    It carries sum * 2^32 + lines as one number and, once enough are found, their number below zero: structs would cost several times as much.
    """
    near = range(2, 5)  # numbers of lines that are tried one by one
    n = near[-1]
    line = lambda k: f"get(len, {at} + {k})" if step > 0 else f"get(len, {at} - {k})"
    if step > 0:
        sums = [f"{' + '.join(line(j) for j in range(k - 1))} + get(bare, {at} + {k - 1})" for k in near]
        begin, chars, width = " + ".join(line(j) for j in range(n)), "(x & 4294967295L)", "(x - (x & 4294967295L))"
        rest = lambda size: f"slice(both, {at} + {n + 1}, {size})"
    else:
        sums = [f"{' + '.join(line(j) for j in range(1, k))} + bare[{at}]" for k in near]
        begin, chars, width = f"{' + '.join(line(j) for j in range(1, n))} + bare[{at}]", "x", "x * 4294967296L"
        rest = lambda size: f"reverse(slice(len, greatest({at} - {n + size - 2}, 1), least({at} - {n - 1}, {size})))"
    fold = lambda size: f"""aggregate({rest(size)}, ({begin}) * 4294967296L + {n},
        (a, x) -> IF(a < 0, a, IF(shiftright(a, 32) + {chars} >= {least_chars}, -(a & 4294967295L) - 1, a + {width} + 1)), a -> IF(a < 0, -a, NULL))"""  # noqa: E731
    return f"CASE {' '.join(f'WHEN {c} >= {least_chars} THEN {k}' for k, c in zip(near, sums, strict=True))} WHEN {most} > {n} THEN coalesce({fold(12)}, {fold(least_chars)}) END"


def chunks(docs: DataFrame, divisor: int, least_chars: int) -> DataFrame:
    """k1, k2, i, k and digest of the chunks of each text (k1, k2, text): k lines from line i on, two lines and ``least_chars`` characters at least.

    One line in ``divisor`` ends at a boundary. With 1 all do, and every run of lines that could be a chunk is covered by chunks that do not leave it.
    """
    d = docs.filter("text <> ''").select("k1", "k2", _lines().alias("lines")).withColumn("n", F.size("lines"))
    d = d.withColumn("ends", F.expr(f"transform(lines, x -> {_bare('x')})"))
    # arrays of their own: fields taken from an array of structs would be taken anew for every element
    # of a number that only counts modulo 2 its last hexadecimal digit is enough
    turn = "array(0L)" if divisor < 2 else "transform(ends, x -> IF(instr('13579bdf', substr(md5(x), 8, 1)) > 0, 1L, 0L))" if divisor == 2 else "transform(ends, x -> cast(conv(substring(md5(x), 1, 8), 16, 10) AS bigint))"
    d = d.select("k1", "k2", "n", F.expr("transform(lines, x -> length(x)) AS len"), F.expr("transform(ends, x -> length(x)) AS bare"), F.expr("transform(lines, x -> xxhash64(x)) AS hash"), F.expr("transform(ends, x -> xxhash64(x)) AS end"), F.expr(f"{turn} AS turn"))
    d = d.withColumn("both", F.expr("zip_with(len, bare, (x, y) -> x * 4294967296L + y)"))
    here = f"i > 0 AND (31 * turn[i - 1] + turn[i]) % {divisor} = 0" if divisor > 1 else "true"
    d = d.withColumn("last", F.expr(f"filter(sequence(0, n - 1), i -> i = n - 1 OR ({here}))"))
    d = d.withColumn("begin", F.expr("concat(array(0), transform(slice(last, 1, size(last) - 1), e -> e + 1))"))
    # a chunk as one number: i * 2^32 + k
    ahead = f"transform(begin, i -> i * 4294967296L + CASE WHEN i < n - 1 THEN {_shortest('i', 1, 'n - i', least_chars)} END)"
    back = f"transform(last, e -> (e + 1) * 4294967296L - 4294967295L * CASE WHEN e > 0 THEN {_shortest('e', -1, 'e + 1', least_chars)} END)"  # from e + 1 - k on
    d = d.withColumn("ahead", F.expr(ahead))
    # characters never fall as a run grows: a whole chunk is long enough if it has no fewer lines than the shortest from its begin
    whole = "transform(last, (e, j) -> CASE WHEN e + 1 > begin[j] + (ahead[j] & 4294967295L) THEN begin[j] * 4294967296L + e + 1 - begin[j] END)"
    d = d.select("k1", "k2", "len", "hash", "end", "bare", F.expr(f"array_compact(array_distinct(concat(ahead, {back}, {whole})))").alias("p"))
    # the digest is a hash of the lines' hashes, where blank lines at the end do not count
    d = d.withColumn("p", F.expr("transform(p, x -> named_struct('i', cast(shiftright(x, 32) AS int), 'k', cast(x & 4294967295L AS int)))"))
    tail = "array_position(reverse(transform(slice(bare, x.i + 1, x.k), b -> b > 0)), true)"
    full = f"CASE WHEN bare[x.i + x.k - 1] > 0 THEN x.k WHEN {tail} > 0 THEN x.k - {tail} + 1 ELSE 0 END"
    long = f"x.full = x.k OR (x.full > 0 AND aggregate(slice(len, x.i + 1, x.full - 1), 0, (a, y) -> a + y) + bare[x.i + x.full - 1] >= {least_chars})"
    found = f"filter(transform(p, x -> named_struct('i', x.i, 'k', x.k, 'full', cast({full} AS int))), x -> {long})"
    d = d.select("k1", "k2", "hash", "end", F.expr(found).alias("found"))
    # from here on code is compiled, as long as no array is made inside explode; of an inner explode the optimizer would infer filters, and evaluate the arrays once more for them
    d = d.select("k1", "k2", "hash", "end", F.explode_outer("found").alias("x")).filter("x IS NOT NULL")
    return d.select("k1", "k2", "x.i", "x.k", F.expr("xxhash64(slice(hash, x.i + 1, x.full - 1), get(end, x.i + x.full - 1))").alias("digest"))


def _meet(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` beside the group (digest, n, ...) of their digest. A group that holds more than one in ``HOT_CHUNKS`` of all rows meets them in several tasks; the list of such groups is that short at any size."""
    share = max(total // HOT_CHUNKS, 1_000)
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = groups.filter(F.col("n") > share).select("digest", salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("k1", "k2", "i"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    return salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), ["digest", "salt"]).drop("salt")


def repeated_spans(docs: DataFrame, scratch: Scratch, divisor: int, least_chars: int) -> DataFrame:
    """k1, k2, i, k of every chunk that an earlier chunk of the corpus equals byte by byte."""
    found = scratch.write(chunks(docs, divisor, least_chars), "chunks")
    often = scratch.write(found.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    scratch.free()
    places = scratch.write(_meet(found, often, found.count()).groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "k", "digest")).alias("c")), "places")
    for name in ("chunks", "often"):
        scratch.drop(name)
    scratch.free()  # before the texts are shuffled
    met = docs.select("k1", "k2", "text").join(places, ["k1", "k2"]).select("k1", "k2", _lines().alias("lines"), "c")
    held = f"transform(c, x -> named_struct('i', x.i, 'k', x.k, 'digest', x.digest, 'chunk', array_join(slice(lines, x.i + 1, x.k), '')))"
    met = scratch.write(met.select("k1", "k2", F.expr(f"explode_outer({held})").alias("c")).filter("c IS NOT NULL").select("k1", "k2", "c.i", "c.k", "c.digest", F.expr(_bare("c.chunk")).alias("chunk")), "candidates")
    scratch.drop("places")
    scratch.free()
    place = F.struct("k1", "k2", "i")
    same = met.groupBy("digest", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    kinds = scratch.write(same.groupBy("digest").agg(F.count("*").alias("kinds"), F.min("first").alias("first"), F.sum("n").alias("n")), "kinds")
    scratch.free()  # the chunks that were shuffled to be compared
    # nearly every digest stands for one string: its rows need no more than the digest to find their first occurrence
    slim = met.select("k1", "k2", "i", "k", "digest")
    found = _meet(slim, kinds.filter("kinds = 1 AND n > 1").drop("kinds"), met.count()).select("k1", "k2", "i", "k", "first")
    clashing = kinds.filter("kinds > 1").select("digest")
    if not clashing.isEmpty():
        apart = met.join(clashing, "digest", "left_semi")
        firsts = apart.groupBy("digest", "chunk").agg(F.min(place).alias("first"))
        found = found.unionByName(apart.join(firsts, ["digest", "chunk"]).select("k1", "k2", "i", "k", "first"))
    return found.filter(place > F.col("first")).select("k1", "k2", "i", "k")


def dedup_lines(docs: DataFrame, divisor: int = 2, least_chars: int = 80) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated chunks of lines cut out of ``text``, and chunks_removed (runs of them), chars_removed (long).

    One line in ``divisor`` ends at a boundary on average. Chunks of less than two lines or ``least_chars`` characters stay; white space
    at a chunk's end does not count. What is left keeps its bytes and order. The first occurrence, by doc_id (null first), text hash
    and place, stays; repeats inside one text go too. Equal rows of one id are one document and stay alike. A text may become empty;
    null stays null and empty stays empty; an empty table gives no rows. Other columns are kept, existing ones of the two names are
    replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("chunks_removed", "chars_removed")
    d = docs.select(*_keys(F.col("doc_id"), F.col("text")), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    spans = scratch.write(repeated_spans(d.select("k1", "k2", "row.text"), scratch, divisor, least_chars).distinct(), "spans")
    for name in ("candidates", "kinds"):
        scratch.drop(name)
    scratch.free()
    # overlapping and touching chunks are one run: [from, to)
    runs = """aggregate(spans, named_struct('done', cast(array() as array<struct<from: int, to: int>>), 'from', spans[0].i, 'to', spans[0].i),
        (a, x) -> IF(x.i <= a.to, named_struct('done', a.done, 'from', a.from, 'to', greatest(a.to, x.i + x.k)),
            named_struct('done', array_append(a.done, named_struct('from', a.from, 'to', a.to)), 'from', x.i, 'to', x.i + x.k)),
        a -> array_append(a.done, named_struct('from', a.from, 'to', a.to)))"""
    cuts = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("i", "k"))).alias("spans")).select("k1", "k2", F.expr(runs).alias("cuts"))
    out = d.join(cuts, ["k1", "k2"], "left").select("row", "cuts", F.when(F.col("cuts").isNotNull(), _lines("row.text")).alias("lines"))
    kept = """array_join(transform(sequence(0, size(cuts)), j -> array_join(slice(lines, IF(j = 0, 0, cuts[j - 1].to) + 1,
        IF(j = size(cuts), size(lines), cuts[j].from) - IF(j = 0, 0, cuts[j - 1].to)), '')), '')"""
    out = out.select("row", "cuts", F.expr(f"CASE WHEN cuts IS NULL THEN row.text ELSE {kept} END").alias("kept"))
    columns = [(F.col("kept") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    removed = F.when(F.col("cuts").isNull(), 0).otherwise(F.length("row.text") - F.length("kept")).cast("long")
    return out.select(*columns, F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long").alias("chunks_removed"), removed.alias("chars_removed"))


def dedup_passages(docs: DataFrame, least_chars: int = 80) -> DataFrame:
    """``dedup_lines`` with a boundary at every line: every repeated run of lines goes, wherever it starts or ends."""
    return dedup_lines(docs, 1, least_chars)
