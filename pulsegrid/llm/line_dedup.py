"""Fuzzy line deduplication by MinHash (DataFrame functions only).

Lines are compared across all documents by the Jaccard similarity of their sets of
character shingles (``k`` characters of the trimmed line). A line's signature is the
sorted list of its smallest shingle hashes; bands are runs of ``rows`` neighbours in
that list, which stay aligned when a hash enters or leaves. Any two lines that share a
band are checked exactly, unless links found before join them already; linked lines are
joined by distributed union-find, and of each component the first line (by document id,
then line number) stays.

Signatures of lines of ``DENSE`` characters or more use the shingles that begin a word of
``WORD`` characters or more if there are ``ENOUGH``; other lines use all shingles, and
lines of up to ``OVERLAP`` characters or twice as many have both. The exact check always
uses all shingles; it is left out only for pairs that a parity profile of all their
shingles shows to be unlike.

Defined cases: blank lines are never compared and always stay; lines of fewer than
``k`` characters match only equal lines; a null text stays null with no lines; null
ids sort first and identical rows share one fate; an empty table
gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, connected_components, fresh, release, stage, table

K, ROWS, BANDS = 8, 3, 10
DENSE, OVERLAP, ENOUGH, WORD = 120, 160, 4, 4
THRESHOLD = 0.8
#: A band is hot if so many lines of one hash in 64 have it.
HOT_BAND = 1_000
#: Lines of a band that meet all others of it in the second round.
HUBS = 16
#: Longs of the bitmap in a line's profile, a power of two.
WORDS = 16


def shingles(line: Column | str, k: int = K) -> Column:
    """64-bit hashes of all distinct shingles of a line, of the line itself if it is shorter."""
    # of four bytes a character, so that each shingle is found by its place; the array holds the line for the inner function
    wide = F.array(F.encode(line, "UTF-32"))
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (4 * k - 1)), F.lit(4))
    found = F.get(F.transform(wide, lambda w: F.transform(at(w), lambda i: F.xxhash64(F.substr(w, i, F.lit(4 * k))))), F.lit(0))
    return F.when(F.length(line) >= 0, F.array_distinct(found))


def _sketch(line: Column, pattern: str) -> Column:
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: F.xxhash64(x))))


def _sketch_ascii(line: Column, k: int) -> Column:
    """The ``_sketch`` of every place of an ASCII line of at least ``k`` characters, without a regular expression."""
    places = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: F.xxhash64(F.substr(w, i, F.lit(k))))
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(line.cast("binary")), places), F.lit(0))))


def _bands(sketch: str, salt: int, rows: int, bands: int) -> Column:
    """Hashes of ``rows`` neighbours from each of the first places that have as many, the first place always; null without a sketch."""
    # one expression for all places: written out, they make a method too long for the JVM to compile
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(bands - 1), F.size(sketch) - rows)))
    return F.when(F.col(sketch).isNotNull(), F.transform(places, lambda i: F.xxhash64(F.lit(salt), *[F.get(sketch, i + j) for j in range(rows)])))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, ln, line): the non-blank lines, trimmed; th is the text's hash."""
    # the outer form adds no filter that would split each text twice; the row of a null text goes with the blank lines
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode_outer(F.split("text", "\n")).alias("ln", "line"))
    return lines.select("doc_id", "th", "ln", F.trim("line").alias("line")).where("line <> ''")


def _links(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u, v) of the pairs whose lines ``lh`` and ``other`` are as alike as ``threshold`` by all their shingles."""
    met = pairs.join(texts, "lh").join(texts.select(F.col("lh").alias("other"), F.col("line").alias("line2")), "other")
    # lines are shuffled, sets are made after the joins
    sets = met.select("u", "v", shingles(F.col("line"), k).alias("s"), shingles(F.col("line2"), k).alias("t"))
    both = sets.select("u", "v", F.size(F.array_intersect("s", "t")).alias("both"), (F.size("s") + F.size("t")).alias("sum"))
    return both.where(F.col("both") >= threshold * (F.col("sum") - F.col("both"))).select("u", "v")


def _open(met: DataFrame, groups: DataFrame) -> DataFrame:
    """``met`` with the group ``g`` of each line and the number ``n`` of lines, for the bands with lines of several groups."""
    left = met.join(groups, met["lh"] == groups["node"], "left").select(*[met[c] for c in met.columns], F.coalesce("root", "lh").alias("g"))
    several = left.groupBy("band").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("n")).where("low <> high")
    return stage(left.join(several.select("band", "n"), "band"), "open")


def _profiles(texts: DataFrame, k: int) -> DataFrame:
    """(lh, p): of each line the number of shingles and, for the hash values of ``64 * WORDS`` bits, the parity of their numbers."""
    word = lambda j: F.expr(f"bit_xor(if((s & {WORDS - 1}) = {j}, shiftleft(1L, cast((s >> 8) & 63 as int)), 0L))").alias(f"b{j}")
    # a column of its own, so that making rows of a set and counting them is compiled as one; no line has an empty set,
    # and the outer form adds no filter that would make each set twice
    sets = texts.select("lh", shingles(F.col("line"), k).alias("set"))
    each = sets.select("lh", F.explode_outer("set").alias("s")).groupBy("lh").agg(F.count("*").alias("size"), *[word(j) for j in range(WORDS)])
    return stage(each.select("lh", F.struct("size", *[f"b{j}" for j in range(WORDS)]).alias("p")), "profiles")


def _alike(p: str, q: str, threshold: float) -> Column:
    """False only for lines whose profiles show that they are less alike than ``threshold``."""
    return (1 + threshold) * _at_most(p, q) >= threshold * (F.col(f"{p}.size") + F.col(f"{q}.size")) - 1e-6


def _at_most(p: str, q: str) -> Column:
    """A bound on the number of shingles that two lines share: parities differ only where one of them has more."""
    apart = sum((F.bit_count(F.col(f"{p}.b{j}").bitwiseXOR(F.col(f"{q}.b{j}"))) for j in range(WORDS)), F.lit(0))
    return (F.col(f"{p}.size") + F.col(f"{q}.size") - apart) / 2


def _exhaust(met: DataFrame, groups: DataFrame, seen: DataFrame, texts: DataFrame, profiles: DataFrame, k: int, threshold: float, hubs: int = HUBS) -> DataFrame:
    """``groups`` (node, root) joined further until no two lines of a band are of different groups and not compared.

    In each round the ``hubs`` lines of a band with the most lines near them meet all its
    lines of other groups and leave it; the next round takes four times as many. Pairs
    that cannot be alike by their profiles are not compared. A band ends when its lines
    are all of one group, so families take few comparisons.
    """
    left = _open(met, groups)
    tables = [groups, left]
    while left.take(1):
        near = left.groupBy("lh").agg(F.sum("n").alias("near"))
        ranked = stage(left.join(near, "lh").join(profiles, "lh").select("band", "lh", "p", "g", "near"), "ranked")
        nth = F.row_number().over(W.partitionBy("band").orderBy(F.desc("near"), "lh"))
        hub = ranked.withColumn("nth", nth).where(F.col("nth") <= hubs).select("band", F.col("lh").alias("h"), F.col("p").alias("q"), F.col("g").alias("hg"))
        hub = stage(hub, "hubs")
        pairs = ranked.join(hub, "band").where((F.col("g") != F.col("hg")) & _alike("p", "q", threshold)).select(
            F.least("lh", "h").alias("lh"), F.greatest("lh", "h").alias("other"), F.least("g", "hg").alias("u"), F.greatest("g", "hg").alias("v")
        ).distinct()
        pairs = stage(pairs.join(seen.select("lh", "other"), ["lh", "other"], "left_anti"), "pairs")
        joined = stage(connected_components(_links(pairs, texts, k, threshold)), "joined")
        further = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = joined.join(groups.select("node"), "node", "left_anti")
        groups = stage(groups.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(new.select("node", "root")), "groups")
        seen = seen.select("lh", "other").union(pairs.select("lh", "other"))
        rest = ranked.join(hub.select("band", F.col("h").alias("lh")), ["band", "lh"], "left_anti").select("band", "lh")
        left = _open(rest, groups)
        tables += [ranked, hub, pairs, joined, groups, left]
        hubs *= 4
    release(*[t for t in tables if t is not groups])
    return groups


def removed_lines(docs: DataFrame, k: int = K, rows: int = ROWS, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, ln) of the lines that repeat, exactly or nearly, an earlier kept line."""
    lines = line_table(docs)
    every, some = f"(?s)(?=(.{{{k}}}))", rf"(?s) (?=(\S{{{min(WORD, k)}}}.{{{k - min(WORD, k)}}}))"
    n, line = F.length("line"), F.col("line")
    # ``lh`` names a line; ``ck`` is a second hash, without which different lines of one ``lh`` would share their fate
    names = [F.xxhash64("line").alias("lh"), F.xxhash64(F.lit(1), "line").alias("ck")]
    # columns of their own, so that each sketch is made once and not for each band; a line of under k characters has none
    sketched = lines.select("doc_id", "th", "ln", "line", *names, F.when(n >= DENSE, _sketch(F.concat(F.lit(" "), line), some)).alias("long"))
    few = F.coalesce(F.size("long"), F.lit(0))
    all_places = (n >= k) & ((n < OVERLAP) | (few < 2 * ENOUGH))
    sketched = sketched.select(
        "doc_id", "th", "ln", "lh", "ck", F.when(few >= ENOUGH, F.col("long")).alias("long"),
        F.when(~all_places, None).when(F.octet_length("line") == n, _sketch_ascii(line, k)).otherwise(_sketch(line, every)).alias("short"),
    )
    none = F.array().cast("array<bigint>")
    short, long = _bands("short", 1, rows, bands), _bands("long", 2, rows, bands)
    both = F.when(F.col("short").isNotNull() & F.col("long").isNotNull(), F.concat(short, long)).otherwise(F.coalesce(short, long, none))
    signed = stage(sketched.select("doc_id", "th", "ln", "lh", "ck", both.alias("bands")), "lines")
    banded = signed.select("lh", F.explode("bands").alias("band")).where("band is not null")
    # bands of very many lines, known by the lines of one hash in 64, need no window to be known as shared
    some = banded.where(F.pmod(F.xxhash64("lh"), F.lit(64)) == 0).groupBy("band").agg(F.count("*").alias("m"), F.min("lh").alias("low"), F.max("lh").alias("high"))
    hot = stage(some.where((F.col("m") > HOT_BAND) & (F.col("low") != F.col("high"))).select("band"), "hot")
    # in no order within a band: rows are sorted by one number
    by_band = W.partitionBy("band")
    usual = banded.join(bounded(hot), "band", "left_anti").select("band", "lh", F.min("lh").over(by_band).alias("hub"), F.max("lh").over(by_band).alias("far"))
    crowd = banded.join(bounded(hot), "band").select("band", "lh").distinct()
    crowd = crowd.join(crowd.groupBy("band").agg(F.min("lh").alias("hub")), "band").select("band", "lh", "hub")
    met = stage(usual.where("hub <> far").select("band", "lh", "hub").union(crowd).distinct(), "met")
    # every line of a band meets the band's smallest one: the same few for most bands of a family
    pairs = met.where("lh <> hub").select(F.col("hub").alias("lh"), F.col("lh").alias("other")).distinct()
    wanted = stage(met.select("lh").distinct(), "wanted")
    texts = line_table(docs).select(*names, "line").join(bounded(wanted), "lh").groupBy("lh").agg(F.min(F.struct("ck", "line")).alias("t"))
    texts = stage(texts.select("lh", "t.ck", "t.line"), "texts")
    profiles = _profiles(texts, k)
    pairs = pairs.join(profiles, "lh").join(profiles.select(F.col("lh").alias("other"), F.col("p").alias("q")), "other").where(_alike("p", "q", threshold))
    pairs = stage(pairs.select("lh", "other", F.col("lh").alias("u"), F.col("other").alias("v")), "pairs")
    groups = stage(connected_components(_links(pairs, texts, k, threshold)), "groups")
    # a line that its band's hub is unlike is still open there, and meets others
    groups = _exhaust(met.where("lh <> hub").select("band", "lh"), groups, pairs, texts, profiles, k, threshold)
    named = texts.select(F.col("lh").alias("node"), F.col("ck").alias("nck"))
    groups = stage(groups.join(named, "node"), "groups")
    release(hot, met, wanted, texts, profiles, pairs)
    place = F.struct("doc_id", "ln", "th")
    first = signed.groupBy("lh", "ck").agg(F.min(place).alias("first"), F.count("*").alias("m"))
    of_group = (first["lh"] == groups["node"]) & (first["ck"] == groups["nck"])
    first = first.join(groups, of_group, "left").select("lh", "ck", "first", "m", F.coalesce("root", "lh").alias("g"), F.when(F.col("root").isNull(), F.col("ck")).alias("gc"))
    first = stage(first, "first")
    shared = first.groupBy("g", "gc").agg(F.min("first").alias("keep"), F.sum("m").alias("m")).where("m > 1").withColumnsRenamed({"g": "kg", "gc": "kc"})
    fate = first.join(shared, (F.col("g") == F.col("kg")) & F.col("gc").eqNullSafe(F.col("kc"))).select("lh", "ck", "keep")
    gone = signed.select("doc_id", "th", "ln", "lh", "ck").join(fate, ["lh", "ck"]).where(~place.eqNullSafe(F.col("keep")))
    return gone.select("doc_id", "th", "ln")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with the removed lines cut from ``text``, and ``__lines`` and ``__cut``, their numbers before and cut."""
    cut, id_, th_, all_ = fresh(docs, "__gone", "__id", "__th", "__all")
    gone = stage(removed_lines(docs, **options).groupBy("doc_id", "th").agg(F.collect_set("ln").alias(cut)), "gone")
    gone = gone.withColumnsRenamed({"doc_id": id_, "th": th_})
    out = docs.join(gone.hint("shuffle_merge"), docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th_)), "left")
    # a column of its own, so that a text is split once
    out = out.withColumn(all_, F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(cut))
    counts = fresh(docs, "__lines", "__cut")
    names = [f"`{c}`" for c in docs.columns if c not in ("text", "n_chars")]
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(all_), i)), "\n"))
    out = out.select(*[F.col(c) for c in names], text.alias("text"), F.coalesce(F.size(all_), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(counts[1]))
    return out


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines cut; ``n_chars``, if there, follows the text."""
    out = dedup(docs, **options).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__cut").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
