"""Near-duplicates by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. A text's words (runs of non-space bytes, A-Z lowered) give the set of its five-word shingles. Rows with equal sets
   form a class, a node of what follows; one signature of K = 64 coordinates stands for it.
2. Of K coordinates, a pair with at least T = 32 matches shares one of any K - T + 1, so only that prefix is posted,
   under (coordinate, value). A list of several entries pairs each with the list's first entry, with the one before
   it, and the same again within the sub-list that also shares two further coordinates: a number of pairs linear in
   the postings however long a list is. Lists longer than SPLIT are dealt in parts. One bit per coordinate travels
   with each posting, so the matches are estimated on the spot and pairs below the threshold are never made.
3. Pairs are confirmed on the full sets of 64-bit shingle hashes: first each node's best pair, then those that still
   join two components of the links found, so copies of copies aren't compared over and over.
4. What step 2 skipped is made up for, exactly. Collisions are counted per node, over all K coordinates, with nodes
   of other components; nodes with fewer than T are skipped. Each of the others is compared with a reference h, the
   one that leads most of its lists by total list length (the text that a cloud of near copies stems from, if there
   is one). With M = h without x and D = x without h, the overlap of two nodes x, y of one reference is
       |h| - |Mx| - |My| + |Mx & My| + |Dx & Dy|
   so a link needs |Mx & My| + |Dx & Dy| >= w(x) + w(y) - |h| / 7, with w = (4 |M| + 3 |D|) / 7. A node linked with
   h is in its component, hence one of two nodes of different components has w > |h| / 7, and the bound is above 0:
   differences have to collide, and of those only the rarest are posted (prefix), with the position bound on the
   rest. Nodes of different references meet in the same way by their shingles. Both joins skip pairs of one
   component, so a cloud of copies costs its differences, not its pairs. Survivors are confirmed like the others.
5. Connected components over the confirmed links.

So every link whose signatures match in at least T coordinates is found or lies within one component; of pairs with
overlap 0.75 a share of 5e-6 has fewer.

Defined results: ids may be of any type that has an order. Null texts and texts without words have an empty set and are
linked with nothing, their component is their id; every row counts by its own text, so repeated rows, and rows of one id
with different texts, are each returned; a null id never names a component, one without any other id has a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.hashing import SPACES, shingles, words
from tidewatch.llm.joins import Scratch, components

K, MATCHES = 64, 32
PREFIX = K - MATCHES + 1
#: entries of a posting list, or nodes of a reference, that are dealt to one task
SPLIT, MEMBERS = 10_000, 500
#: of one bit per coordinate; a pair of overlap 0.75 has 56 equal bits on average, with deviation 2.6
LEAST_BITS = 44
#: a node that shares less than this part of its set with its reference goes without one
SHARED = 8
NUMERATOR, DENOMINATOR = 75, 100
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_WORD = ~SPACES


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(shingles(words(text.encode("utf-8", "surrogatepass"), _WORD)[0]))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(K, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 2048):
        h = s[i : i + 2048, None] * _MULTIPLY + _ADD
        out = np.minimum(out, (h >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(h1), int(h2)


_LONGS = [T.StructField(c, T.LongType()) for c in ("h1", "h2", "n", "bits")]
SIGNED = T.StructType([*_LONGS, T.StructField("sig", T.ArrayType(T.IntegerType()))])
SET = T.StructType([*_LONGS[:2], T.StructField("set", T.ArrayType(T.LongType()))])


@F.pandas_udf(SIGNED)
def _sign(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        s = shingle_set(t)
        if not len(s):
            rows.append((0, 0, 0, 0, None))
            continue
        g = signature(s)
        # the bit comes from the middle: the top bits of a minimum are mostly zero
        bits = np.packbits(((g * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)
        rows.append((*_digest(s), len(s), int(bits[0]), g.view(np.int32)))
    return pd.DataFrame(rows, columns=SIGNED.names)


@F.pandas_udf(SET)
def _set(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame([(*_digest(s), s.view(np.int64)) for s in sets], columns=SET.names)


def _sets(texts: DataFrame, reps: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(_node, _set) of `nodes`: texts meet by 64 bits of theirs, and are told by the digest of their set."""
    nodes = reps.select("_node", "_x", "_h1", "_h2").join(nodes, "_node", "left_semi")
    one = texts.join(nodes.select("_x").distinct(), "_x", "left_semi").dropDuplicates(["_x"])
    s = one.select("_x", _set("_text").alias("s")).select("_x", "s.set", F.col("s.h1").alias("_h1"), F.col("s.h2").alias("_h2"))
    return scratch.store(s.join(nodes, ["_x", "_h1", "_h2"]).select("_node", F.col("set").alias("_set")))


def _proposed(reps: DataFrame, split: int) -> DataFrame:
    """(a, b, bits): pairs a < b that share a posting list of the prefix and enough bits."""
    other = lambda k: F.xxhash64(F.col("_sig")[(k + 37) % K], F.col("_sig")[(k + 51) % K])
    entry = [F.struct(F.xxhash64(F.lit(k), F.col("_sig")[k]).alias("key"), other(k).alias("sub")) for k in range(PREFIX)]
    p = reps.select("_node", "_bits", F.explode(F.array(*entry)).alias("e")).select(F.col("e.key").alias("_key"), F.col("e.sub").alias("_sub"), "_node", "_bits")
    # counted with partial sums, so that a long list is a row per task; most lists have one entry and end here
    lists = p.groupBy("_key").agg(F.count(F.lit(1)).alias("_entries"), F.min("_node").alias("_lead"), F.min_by("_bits", "_node").alias("_lead_bits")).filter("_entries > 1")
    p = p.join(lists, "_key").withColumn("_part", F.pmod(F.xxhash64("_node"), F.ceil(F.col("_entries") / split)))
    whole, part = Window.partitionBy("_key", "_part").orderBy("_node"), Window.partitionBy("_key", "_part", "_sub").orderBy("_node")
    me = F.struct(F.col("_node").alias("id"), F.col("_bits").alias("bits"))
    lead = F.struct(F.col("_lead").alias("id"), F.col("_lead_bits").alias("bits"))
    p = p.select("_node", "_bits", F.array(lead, F.lag(me).over(whole), F.first(me).over(part), F.lag(me, 1).over(part), F.lag(me, 2).over(part)).alias("_near"))
    same = lambda o: F.lit(K) - F.bit_count(o["bits"].bitwiseXOR(F.col("_bits")))
    p = p.select("_node", F.array_distinct(F.transform(F.filter("_near", lambda o: o.isNotNull() & (o["id"] != F.col("_node")) & (same(o) >= LEAST_BITS)), lambda o: F.struct(o["id"].alias("a"), same(o).alias("bits")))).alias("_near"))
    p = p.filter(F.size("_near") > 0).select(F.col("_node").alias("b"), F.explode("_near").alias("n"))
    # counting collisions per pair: partial sums come before the shuffle
    return p.groupBy(F.col("n.a").alias("a"), "b").agg(F.max("n.bits").alias("bits"), F.count(F.lit(1)).alias("collisions"))


def _linked(i: Column, n: Column) -> Column:
    """Whether overlap i of two sets with n members together is enough."""
    return i * DENOMINATOR >= (n - i) * NUMERATOR


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose overlap reaches the threshold; their sets meet by joins, where AQE splits hot nodes."""
    j = pairs.join(sets.select(F.col("_node").alias("b"), F.col("_set").alias("_sb")), "b").join(sets.select(F.col("_node").alias("a"), F.col("_set").alias("_sa")), "a")
    j = j.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).cast("long").alias("i"), (F.size("_sa") + F.size("_sb")).cast("long").alias("n"))
    return j.filter(_linked(F.col("i"), F.col("n"))).select("a", "b")


def _labelled(nodes: DataFrame, label: DataFrame | None) -> DataFrame:
    """`nodes` with `_component`: that of the links, or the node itself."""
    if label is None:
        return nodes.withColumn("_component", F.col("_node"))
    found = label.select(F.col("node").alias("_node"), F.col("component").alias("_label"))
    return nodes.join(found, "_node", "left").withColumn("_component", F.coalesce("_label", "_node")).drop("_label")


def _rows(docs: DataFrame, id_col: str, text_col: str, split: int, scratch: Scratch) -> DataFrame:
    """_id, _x (64 bits of the text), _n, _component (a node, null without words) and _least (the component's least id) of every row."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_x", F.xxhash64("_text"))
    signed = d.select("_id", "_x", _sign("_text").alias("s")).select("_id", "_x", *[F.col(f"s.{c}").alias(f"_{c}") for c in ("n", "h1", "h2", "bits", "sig")])
    signed = scratch.store(signed.withColumn("_node", F.monotonically_increasing_id()))
    key = ["_n", "_h1", "_h2"]
    classes = scratch.store(signed.filter("_n > 0").groupBy(*key).agg(F.min("_node").alias("_node"), F.min("_id").alias("_least")))
    inner = Scratch(docs.sparkSession)
    label = _links(d.select("_x", "_text"), signed.join(classes.select("_node"), "_node", "left_semi").drop("_id"), split, inner)
    named = classes.withColumn("_component", F.col("_node"))
    if label is not None:
        # the least id of a component: partial minima before the shuffle
        ends = label.select(F.col("node").alias("_node"), "component").join(classes.select("_node", "_least"), "_node")
        least = ends.groupBy("component").agg(F.min("_least").alias("_of"))
        ends = inner.store(ends.select("_node", "component").join(least, "component"))
        named = classes.join(ends, "_node", "left").select(*key, F.coalesce("component", "_node").alias("_component"), F.coalesce("_of", "_least").alias("_least"))
    # stored, so that both sides of the join are plain exchanges and AQE can split a large class
    named = scratch.store(named.select(*key, "_component", "_least"))
    inner.drop()
    return signed.select("_id", "_x", "_node", *key).join(named, key, "left").select("_id", "_x", "_node", "_n", "_component", "_least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    rows = _rows(docs, id_col, text_col, split, Scratch(docs.sparkSession))
    component = F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_id"))
    return rows.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _links(texts: DataFrame, reps: DataFrame, split: int, scratch: Scratch) -> DataFrame | None:
    """(node, component) of all nodes that have links; None without links."""
    reps = scratch.store(reps)
    pairs = scratch.store(_proposed(reps, split))
    links, label = None, None
    if not pairs.isEmpty():
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("bits", -F.col("a"))).alias("a")).select("a", "b")
        sets = _sets(texts, reps, pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), scratch)
        links = scratch.store(confirm(best, sets))
        label = components(links, scratch)
        side = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        rest = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
        rest = rest.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
        links, label = _more(links, label, confirm(rest, sets), scratch)
    return _skipped(texts, reps, links, label, scratch)


def _more(links: DataFrame | None, label: DataFrame | None, found: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """Links and labels with those of `found`."""
    found = scratch.store(found)
    if found.isEmpty():
        return links, label
    links = found if links is None else links.unionByName(found)
    return links, components(links, scratch)


def _references(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(_node, _ref): the node that leads most of its lists. A list's leader has the longest lists in sum, so the cloud's origin leads."""
    scored = held.select("_node", F.aggregate("_held", F.lit(0).cast("long"), lambda s, o: s + o["_entries"]).alias("_score"), F.explode("_held._key").alias("_key"))
    leads = scored.groupBy("_key").agg(F.max(F.struct("_score", (-F.col("_node")).alias("_less"))).alias("m")).select("_key", (-F.col("m._less")).alias("_lead"))
    leads = scratch.store(leads)  # small beside the lists, and known to be
    ref = scored.join(leads, "_key").groupBy("_node", "_lead").count().groupBy("_node").agg(F.max_by("_lead", F.struct("count", -F.col("_lead"))).alias("_ref"))
    ref = scratch.store(ref)
    for _ in range(2):  # a reference's own reference leads both
        up = ref.select(F.col("_node").alias("_ref"), F.col("_ref").alias("_up"))
        ref = ref.join(up, "_ref", "left").select("_node", F.coalesce("_up", "_ref").alias("_ref"))
    return scratch.store(ref)


def _rarest(nodes: DataFrame, features: str, group: str, columns: list[str], scratch: Scratch) -> DataFrame:
    """`columns` of each node, with `_rare`: its features that nodes of another group hold, rarest first."""
    f = nodes.select("_node", group, F.explode(features).alias("_f"))
    shared = f.groupBy("_f").agg(F.count(F.lit(1)).alias("_c"), F.min(group).alias("_lo"), F.max(group).alias("_hi")).filter("_lo <> _hi").select("_f", "_c")
    shared = scratch.store(shared)
    # a node's features: at most the shingles of it and of its reference
    rare = f.select("_node", "_f").join(shared, "_f").groupBy("_node").agg(F.sort_array(F.collect_list(F.struct("_c", "_f"))).alias("_rare"))
    return scratch.store(nodes.select(*columns).join(rare, "_node"))


def _posted(nodes: DataFrame, least: Column, side: str) -> DataFrame:
    """A node that needs an overlap of `least` posts as many of its features as it takes; `_left` bounds the overlap from there on."""
    some = F.slice("_rare", F.lit(1), F.size("_rare") - least + 1)
    p = nodes.withColumn("_r", F.size("_rare")).filter(F.col("_r") >= least).select("*", F.posexplode(some).alias("_p", "_o"))
    p = p.withColumn("_f", F.col("_o._f")).withColumn("_left", F.col("_r") - F.col("_p")).drop("_rare", "_o", "_p", "_r")
    return p.select([F.col(c).alias(f"{c}{side}") for c in p.columns])


def _met(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """(a, b): pairs of nodes with a common posting that meet the condition."""
    j = left.join(right, (F.col("_fa") == F.col("_fb")) & (F.col("_nodea") != F.col("_nodeb")) & (F.col("_componenta") != F.col("_componentb")) & condition)
    return j.select(F.least("_nodea", "_nodeb").alias("a"), F.greatest("_nodea", "_nodeb").alias("b")).distinct()


def _skipped(texts: DataFrame, reps: DataFrame, links: DataFrame | None, label: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """Step 4: labels with the links that the proposals skipped."""
    r = _labelled(reps.select("_node", "_sig"), label)
    values = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("_sig")[k]) for k in range(K)])).alias("_key")
    mixed = r.select("_component", values).groupBy("_key").agg(F.min("_component").alias("_least"), F.max("_component").alias("_most"), F.count(F.lit(1)).alias("_entries"))
    mixed = scratch.store(mixed.filter("_least <> _most").select("_key", "_entries"))
    held = r.select("_node", values).join(mixed, "_key").groupBy("_node").agg(F.sort_array(F.collect_list(F.struct("_entries", "_key"))).alias("_held"))
    held = scratch.store(held.filter(F.size("_held") >= MATCHES))
    if held.isEmpty():
        return label
    ref = _references(held, scratch)
    sets = _sets(texts, reps, ref.select("_node"), scratch)
    # a reference with many nodes is dealt over several tasks
    parts = scratch.store(ref.groupBy("_ref").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_parts")))
    mine = ref.join(parts, "_ref").withColumn("_part", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int")).select("_node", "_ref", "_part")
    mine = scratch.store(mine)
    of = sets.join(parts.withColumnRenamed("_ref", "_node"), "_node").select(F.col("_node").alias("_ref"), F.col("_set").alias("_base"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    x = sets.join(mine, "_node").join(of, ["_ref", "_part"])
    x = x.select("_node", "_ref", "_set", F.size("_set").alias("_n"), F.size("_base").alias("_h"), F.array_except("_base", "_set").alias("_m"), F.array_except("_set", "_base").alias("_d"))
    x = x.withColumn("_i", F.size("_set") - F.size("_d"))
    feature = lambda sign, c: F.transform(c, lambda s: F.xxhash64(F.col("_ref"), F.lit(sign), s))
    x = x.withColumn("_near", (F.col("_i") * SHARED >= F.col("_n")) | (F.col("_ref") == F.col("_node")))
    x = scratch.store(x.select(
        "_node", "_ref", "_near", "_set", "_n", "_i", "_h", (F.size("_m") + F.size("_d")).alias("_size"), (4 * F.size("_m") + 3 * F.size("_d")).alias("_w"),
        F.when(F.col("_near"), F.concat(feature(0, "_m"), feature(1, "_d"))).otherwise(F.array()).alias("_features")))
    found = x.filter(F.col("_node") != F.col("_ref")).filter(_linked(F.col("_i"), F.col("_n") + F.col("_h")))
    links, label = _more(links, label, found.select(F.least("_node", "_ref").alias("a"), F.greatest("_node", "_ref").alias("b")), scratch)
    x = _labelled(x, label).withColumn("_group", F.when(F.col("_near"), F.col("_ref")).otherwise(F.col("_node")))

    # one reference: differences collide; _w is 7 w. One node of a pair isn't linked with the reference, which bounds its overlap
    least = F.least("_lefta", "_leftb")
    near = _rarest(x.filter("_near"), "_features", "_component", ["_node", "_component", "_ref", "_h", "_w"], scratch)
    far = _posted(near.filter("_w > _h"), F.greatest(F.lit(1), F.ceil((F.col("_w") - F.col("_h")) / 4)).cast("int"), "a")
    met = _met(far, _posted(near, (F.floor(F.col("_w") / 7) + 1).cast("int"), "b"), least * 7 >= F.col("_wa") + F.col("_wb") - F.col("_ha"))
    # different references: shingles collide, of nodes that share enough coordinates with other references' nodes
    keys = held.select("_node", F.explode("_held._key").alias("_key")).join(x.select("_node", "_group"), "_node")
    between = keys.groupBy("_key").agg(F.min("_group").alias("_lo"), F.max("_group").alias("_hi")).filter("_lo <> _hi").select("_key")
    open_ = keys.join(between, "_key").groupBy("_node").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= MATCHES).select("_node")
    apart = _rarest(x.join(open_, "_node", "left_semi"), "_set", "_group", ["_node", "_component", "_group", "_n"], scratch)
    apart = [_posted(apart, F.ceil(F.col("_n") * NUMERATOR / DENOMINATOR).cast("int"), s) for s in "ab"]
    total = F.col("_na") + F.col("_nb")
    met = met.union(_met(*apart, (F.col("_nodea") < F.col("_nodeb")) & (F.col("_groupa") != F.col("_groupb")) & _linked(least, total)))
    met = scratch.store(met.distinct())
    if met.isEmpty():
        return label
    ends = met.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    return _more(links, label, confirm(met, x.select("_node", "_set").join(ends, "_node", "left_semi")), scratch)[1]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group: of those of least id (ids that are null come last) any one.

    Documents without words are in no group and stay.
    """
    scratch, inner = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = inner.store(_rows(docs, id_col, text_col, SPLIT, inner).filter("_n > 0"))
    best = rows.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("_null"), F.col("_id").alias("_id"), F.col("_x").alias("_x"))).alias("m"))
    best = inner.store(best.select("_component", F.col("m._id").alias("_best"), F.col("m._x").alias("_bx")))
    same = F.col("_id").eqNullSafe(F.col("_best")) & (F.col("_x") == F.col("_bx"))
    # what goes, and what stays once of several equal rows
    rows = rows.join(best, "_component").groupBy("_id", "_x").agg(F.max(same).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    listed = inner.store(rows.filter("not _stays or _rows > 1"))
    key = (F.col("_id").eqNullSafe(F.col("_gid"))) & (F.col("_x") == F.col("_gx"))
    gone, once = (scratch.store(listed.filter(c).select(F.col("_id").alias("_gid"), F.col("_x").alias("_gx"))) for c in ("not _stays", "_stays"))
    inner.drop()
    d = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_x")).join(gone, key, "left_anti")
    if once.isEmpty():
        return d.select("_row.*")
    once = once
    single = d.join(once, key, "left_anti")
    return single.unionByName(d.join(once, key, "left_semi").dropDuplicates(["_id", "_x"])).select("_row.*")


__all__ = ["confirm", "deduplicate", "near_duplicates", "shingle_set", "signature"]
