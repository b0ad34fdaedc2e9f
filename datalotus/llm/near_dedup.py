"""MinHash near-dedup by a signature-coordinate inverted join (DataFrame only).

A signature has `COORDS` coordinates, each the hash of `ROWS` minima of
independent hash functions over a document's distinct 2-word shingles. Two
documents agree at a coordinate with probability J**ROWS.

1. Documents with one and the same shingle set form a class; only one signature
   per class goes on, copies keep a membership row.
2. Prefix merging: a pair that matches at `MATCHES` of the `COORDS` coordinates
   matches at least once among any COORDS - MATCHES + 1 of them, so only those are
   posted under (coordinate, value). Entries of one list whose set sizes differ too
   much for the threshold never meet (size bands).
3. Lists are merged in two passes, so that a list of L near copies costs L pairs
   and not L*L. First each entry meets the smallest entry of its list and band;
   accepted links give components. Then, within each list, only entries that are
   still in different components meet: first those outside the list's main component
   with about `SAMPLE` entries, so that most of them join it by a few links, then all
   that are still apart. A pair of one component can't change the result, so no link
   between different texts is lost.
   Each entry brings `BITS` parity bits of its set. A shingle of one set alone flips
   one bit, so two sets differ in at least as many shingles as bits; pairs whose bits
   differ too much for the threshold end inside the join and are never written. That
   is a proof, not an estimate: no pair at the threshold ends there.
4. Merging counts a pair's collisions over the lists. A pair that reaches `MATCHES`
   there is a candidate. For the others the merge skips the rest: what the lists
   didn't show (coordinates beyond the prefix, lists with another head) is looked up
   in the two signatures, and only pairs that could still reach `MATCHES` are.
5. Candidates are confirmed on the full sets in integers:
   100 * |A and B| >= 80 * |A or B|.

Sets are sets of 64-bit hashes of the shingles, and classes go by the set's size and
128 bits of order-free fingerprint: a result could differ from that on the shingles
themselves only by a collision of those hashes.

Scale: joins on a list, a root or a component, which a third of all rows may share,
are split by `spread_join` into parts of `HOT` rows. A list of L entries that are
all unlinked costs about L*L/2 comparisons of bits in blocks of `BLOCK`; none is left
out. Sets of more than about 2 * `BITS` shingles fill their bits, so few of their
pairs end early; such pairs go on to the full sets.

With 3 minima, 30 coordinates and 3 matches, a pair exactly at the threshold
(J = 0.8) is overlooked with probability 2e-7, one at 0.85 with 3e-10.

Defined cases: null and empty texts have an empty set and are linked with
nothing, even with each other; one word is a set of one. Repeated rows each keep
their row and share a component. Rows without doc_id take part; a component's id
is the smallest doc_id in it, null if it has none, and such rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalotus.llm.common import Tables, column, lower_ascii, materialize, row, words

COORDS, ROWS, MATCHES = 30, 3, 3
THRESHOLD = 80  # percent
BLOCK = 1024  # entries of a list that meet in one piece
HOT = 1 << 18  # rows of one key that a task joins
BITS = 1024  # parity bits of a set, in longs of 64; a power of two
SAMPLE = 16  # entries of a list that the others meet before all meet


def shingles(text: Column) -> Column:
    """Distinct 2-word shingles as 64-bit hashes."""
    w = words(lower_ascii(text))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.transform(w, lambda a: F.xxhash64(a, F.lit("\n"))))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, th, n (set size), x1 and x2 (order-free fingerprint of
    the set), bits (struct of its parity bits), sig (array of `COORDS` longs)."""
    text = F.coalesce(column(text_col), F.lit(""))
    # rows repeated with one id and text are told apart by `r`, else their shingles would cancel
    sets = docs.select(F.monotonically_increasing_id().alias("r"), column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), shingles(text).alias("s")).select("r", "id", "th", F.size("s").alias("n"), F.explode_outer("s").alias("h"))
    low = (1 << 32) - 1
    minima = []
    for k in range((COORDS * ROWS + 1) // 2):
        mixed = F.xxhash64("h", F.lit(k))
        minima += [F.min(mixed.bitwiseAND(F.lit(low))).alias(f"m{2 * k}"), F.min(F.shiftrightunsigned(mixed, 32)).alias(f"m{2 * k + 1}")]
    bit, longs = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")), F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITS // 64 - 1))
    bits = [F.bit_xor(F.when(longs == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(BITS // 64)]
    flat = sets.groupBy("r", "id", "th", "n").agg(F.bit_xor(F.xxhash64("h", F.lit(-1))).alias("x1"), F.bit_xor(F.xxhash64("h", F.lit(-2))).alias("x2"), *bits, *minima[: COORDS * ROWS])
    coordinate = [F.xxhash64(*[F.col(f"m{ROWS * c + r}") for r in range(ROWS)]) for c in range(COORDS)]
    return flat.select("id", "th", "n", "x1", "x2", F.struct(*[f"b{k}" for k in range(BITS // 64)]).alias("bits"), F.array(*coordinate).alias("sig"))


def _band(n: Column) -> Column:
    """Sets whose sizes are within the threshold differ by one band at most."""
    return F.floor(F.log(n.cast("double")) / F.lit(_log_ratio()) + F.lit(1e-9)).cast("int")


def _log_ratio() -> float:
    from math import log

    return log(100 / THRESHOLD) + 1e-9


def _fits(a: Column, b: Column) -> Column:
    return (100 * F.least(a, b)) >= (THRESHOLD * F.greatest(a, b))


def _may_reach(a: str, b: str, na: Column, nb: Column) -> Column:
    """False only for pairs below the threshold: sets that differ in x shingles reach it
    if (100 + THRESHOLD) * x <= (100 - THRESHOLD) * (na + nb), and x is at least the
    number of parity bits that differ."""
    differ = F.lit(0)
    for k in range(BITS // 64):
        differ = differ + F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}")))
    return ((100 + THRESHOLD) * differ) <= ((100 - THRESHOLD) * (na + nb))


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on `key`, unique in `one`. A key with more than `HOT` rows of `many`
    is split by a hash of `by` into parts of about that size, and its row of `one` is
    repeated for each. `counts` (key, len) saves counting the keys."""
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("len")) if counts is None else counts
    # at most rows / HOT keys
    heavy = F.broadcast(counts.where(F.col("len") > HOT).select(F.col(key), F.ceil(F.col("len") / F.lit(HOT)).cast("int").alias("parts")))
    salted = many.join(heavy, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts").cast("long")).cast("int"), F.lit(0))).drop("parts")
    repeated = one.join(heavy, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(repeated, [key, "salt"]).drop("salt")


def _matched(pairs: DataFrame, classes: DataFrame, label: str, tables: Tables) -> DataFrame:
    """(a, b, na, nb) of the pairs with enough collisions. `pairs` has a row (a, b, na,
    nb) for each list that showed the pair."""
    met = materialize(pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("seen")), f"met-{label}", tables)
    side = classes.select("cid", "sig")
    few = met.where(F.col("seen") < MATCHES)
    both = few.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda t: t))
    enough = met.where(F.col("seen") >= MATCHES).select("a", "b", "na", "nb").union(both.where(agree >= MATCHES).select("a", "b", "na", "nb"))
    return materialize(enough, f"near-{label}", tables)


def _sets(pairs: DataFrame, have: DataFrame | None, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, tables: Tables) -> DataFrame:
    """(cid, s): the full sets of the classes in `pairs`, read from one document of
    each class; those in `have` aren't read again."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    if have is not None:
        wanted = wanted.join(have.select("cid"), "cid", "left_anti")
    none = F.lit(-(1 << 62))  # stands for a missing id
    wanted = wanted.join(classes, "cid").select("cid", F.coalesce("rid", none).alias("id"), F.col("rth").alias("th"))
    text = F.coalesce(column(text_col), F.lit(""))
    texts = docs.select(F.coalesce(column(id_col).cast("long"), none).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    read = texts.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("cid", shingles(F.col("t")).alias("s"))
    read = materialize(read, "sets", tables)
    return read if have is None else have.union(read)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    both = pairs.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b").withColumn("i", F.size(F.array_intersect("wa", "wb")))
    return both.where((100 * F.col("i")) >= (THRESHOLD * (F.col("na") + F.col("nb") - F.col("i")))).select("a", "b")


def components(edges: DataFrame, label: str, tables: Tables) -> DataFrame:
    """(node, root): the smallest node reachable. Rounds of neighbour minima, each
    followed by a jump to the root's root, written to the shared folder."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), f"edges-{label}", tables)
    degrees = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"), F.count(F.lit(1)).alias("len")), f"roots-{label}", tables)
    roots, hubs = degrees.select("node", "root"), degrees.select(F.col("node").alias("b"), "len")
    while True:
        far = spread_join(both, roots.toDF("b", "rb"), "b", "a", hubs).groupBy(F.col("a").alias("node")).agg(F.min("rb").alias("m"))
        step = materialize(roots.join(far, "node").select("node", F.least("root", "m").alias("next"), "root"), f"steps-{label}", tables)
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        new = materialize(spread_join(step, jump, "next", "node").select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("moved")), f"roots-{label}", tables)
        roots = new.select("node", "root")
        if new.where("moved").isEmpty():
            return roots


def _apart(lists: DataFrame, roots: DataFrame, bits: DataFrame, sample: int | None, tables: Tables) -> DataFrame:
    """(a, b, na, nb) of the pairs of a list's entries in different components whose
    parity bits leave the threshold open, a row for each list. With `sample`, only pairs
    with one of about so many entries of the list, drawn by hash."""
    mine = lists.drop("head", "head_n").join(roots.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    by_root = mine.groupBy("list", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_root.groupBy("list").agg(F.sum("m").alias("size"), F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main")).where("roots > 1").drop("roots")
    mixed = materialize(mixed, "mixed", tables)
    # a pair of two components has an entry outside the list's main component; such
    # entries meet the list's entries, which are cut into blocks by a hash
    met = spread_join(mine, mixed.drop("size"), "list", "cid", mixed.select("list", F.col("size").alias("len"))).withColumn("k", F.ceil(F.col("len") / F.lit(BLOCK)).cast("int"))
    open_lists = materialize(met.join(bits, "cid"), "open", tables)
    drawn = open_lists
    if sample:
        # powers of two, so that lists of about one length draw the same entries
        one_in = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.floor(F.log2(F.col("len") / F.lit(float(sample)))), F.lit(0)).cast("int"))
        drawn = open_lists.where(F.pmod(F.xxhash64("cid", F.lit(-3)), one_in) == 0)
    left = open_lists.where("root != main").select("list", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("root").alias("qa"), F.col("home").alias("ha"), F.col("bits").alias("ba"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("p"))
    right = drawn.select("list", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("qb"), F.col("home").alias("hb"), F.col("bits").alias("bb"), "main", F.pmod(F.xxhash64("cid"), F.col("k").cast("long")).cast("int").alias("p"))
    once = (F.col("qb") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, ["list", "p"]).where((F.col("qa") != F.col("qb")) & _fits(F.col("na"), F.col("nb")) & (F.col("ha") | F.col("hb")) & (F.lit(True) if sample else once) & _may_reach("ba", "bb", F.col("na"), F.col("nb")))
    flip = F.col("a") > F.col("b")
    pairs = pairs.select("list", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(flip, F.col("na")).otherwise(F.col("nb")).alias("nb"))
    # two drawn entries outside the main component meet from both sides
    return (pairs.dropDuplicates(["list", "a", "b"]) if sample else pairs).drop("list")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (xxhash64
    of the text, which tells rows with one id apart). It reads some of `tables`."""
    tables, passing = tables or Tables(docs.sparkSession), Tables(docs.sparkSession)
    signed = materialize(signatures(docs, id_col, text_col), "signatures", tables)
    rep = F.min(F.struct(F.col("id").isNull(), "id", "th"))
    classes = signed.where("n > 0").groupBy("n", "x1", "x2").agg(rep.alias("r"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    # written once, so the numbers hold; they are shorter than the fingerprints
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "n", "x1", "x2", "sig", "bits", F.col("r.id").alias("rid"), F.col("r.th").alias("rth")), "classes", tables)

    # lists are named by a hash of coordinate and value; a clash only adds candidates
    posted = classes.select("cid", "n", F.posexplode(F.slice("sig", 1, COORDS - MATCHES + 1)).alias("c", "v")).select("cid", "n", F.xxhash64("c", "v").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("len")).where("len > 1").select("key")
    met = posted.join(shared, "key", "left_semi").withColumn("band", _band(F.col("n")))
    # an entry stands in its own band and visits the next one; pairs of two visitors aren't made
    stands = F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))
    entries = met.select(F.explode(stands).alias("e"), "key", "cid", "n").select(F.xxhash64("key", "e.band").alias("list"), "e.home", "cid", "n")
    groups = entries.groupBy("list").agg(F.count(F.lit(1)).alias("len"), F.min(F.struct(~F.col("home"), "cid", "n")).alias("head"), F.bool_or("home").alias("any_home")).where("len > 1 and any_home")
    groups = materialize(groups.select("list", "len", F.col("head.cid").alias("head"), F.col("head.n").alias("head_n")), "heads", passing)
    lists = materialize(spread_join(entries, groups, "list", "cid", groups.select("list", "len")), "lists", passing)

    stars = lists.where((F.col("cid") != F.col("head")) & _fits(F.col("n"), F.col("head_n")))
    flip = F.col("cid") > F.col("head")
    first = _matched(stars.select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b"), F.when(flip, F.col("head_n")).otherwise(F.col("n")).alias("na"), F.when(flip, F.col("n")).otherwise(F.col("head_n")).alias("nb")), classes, "star", passing)
    sets = _sets(first, None, classes, docs, id_col, text_col, passing)
    links = materialize(_confirm(first, sets), "links", passing)
    roots = components(links, "star", tables)

    # second pass: entries of a list in different components, first with a sample
    bits, tried = classes.select("cid", "bits"), first
    for sample in (SAMPLE, None):
        rest = _apart(lists, roots, bits, sample, passing)
        # candidates of the passes before failed there, since their ends are apart
        more = _matched(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), classes, "rest", passing)
        if more.isEmpty():
            continue
        sets = _sets(more, sets, classes, docs, id_col, text_col, passing)
        new = materialize(_confirm(more, sets), "links", passing)
        tried = tried.union(more)
        if not new.isEmpty():
            links = links.union(new)
            roots = components(links, "rest", tables)
    passing.release()

    known = classes.select("cid", "n", "x1", "x2").join(roots.toDF("cid", "root"), "cid", "left").select("n", "x1", "x2", F.coalesce("root", "cid").alias("g"))
    found = signed.where("n > 0").select("id", "th", "n", "x1", "x2").join(known, ["n", "x1", "x2"]).select("id", "th", "n", "g")
    smallest = found.groupBy("g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("len"))
    linked = spread_join(found, smallest.drop("len"), "g", "th", smallest.select("g", "len")).select("id", "th", "n", "least").union(signed.where("n = 0").select("id", "th", "n", F.col("id").alias("least")))
    rows = linked.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"), F.col("th").alias("text_hash"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "text_hash")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """`docs` with one document of each group, all columns. Rows are told apart by id
    and text, so one that shares its id with a dropped row stays."""
    drop = near_groups(docs, id_col, text_col, tables).where(~F.col("kept")).select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_th")).distinct()
    tagged = docs.select(row(docs).alias("doc"), column(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(column(text_col), F.lit(""))).alias("th"))
    return tagged.join(drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left_anti").select("doc.*")
