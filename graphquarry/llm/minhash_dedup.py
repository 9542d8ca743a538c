"""Near duplicates: MinHash signatures, a multi-index Hamming join over them, and links confirmed on full shingle sets.

A signature has LANES lanes of 16 bits. It is split into chunks of four lanes. Two signatures that differ in at most
2 * chunks - 1 lanes agree in at least three lanes of some chunk (pigeonhole), so the one error that a chunk may have is
enumerated: each chunk gives four keys, each without one of its lanes. All pairs under that distance share a key. Pairs
at a Jaccard similarity of 0.75 exceed it with probability 2e-4 and even then share a key in all but about 1e-7 of cases.
Of these, step 3 leaves out those that agree in fewer than MATCHES lanes: probability 3.9e-6 at 0.75 (binomial, 48 lanes).

Which documents are connected is decided without writing all pairs of a bucket:
1. Documents of equal sets are one class, represented by its smallest id.
2. Star round: the hub of a bucket (the documents of a key) is the member that shares most keys. Each document is held
   against the hub that it agrees with most.
3. Buckets that still hold more than one component: pairs of different components whose sizes allow a link and that agree
   in MATCHES lanes. A large bucket is dealt out in pieces.
4. Except for dense buckets (more than `pair_limit` members, a quarter of which resemble the hub), where too many pairs
   would agree: the documents of dense buckets that overlap form a family. Families are compared exactly in blocks of
   about `block` by `block` documents; a block gives one link for a document and a component. Nothing is capped.
Every link is confirmed with the full sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, if_small, materialise, small_batches
from .shingles import mix, shingle_sets

LANES, CHUNK = 48, 4
CHUNKS = LANES // CHUNK
MATCHES = 22
#: Lanes that a document and its hub must agree in to be compared in the star round. Only the work depends on it.
STAR_MATCHES = 28
PAIR_LIMIT = 64
BLOCK = 256
#: Members of one piece of a large bucket.
PIECE = 1024
#: What tells classes of equal sets apart.
CLASS = ["n_shingles", "low", "high"]
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75

_rng = np.random.default_rng(7)
FLIPS = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Of non-empty sets: one row of LANES 16-bit values for each; of the least value of each of LANES hash functions, the
    lowest 16 bits."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)][:-1])
    out = np.empty((len(sets), LANES), np.uint16)
    for k in range(LANES):
        v = (flat ^ FLIPS[k]) * FACTORS[k]
        v ^= v >> np.uint64(29)
        out[:, k] = np.minimum.reduceat(v, starts).astype(np.uint16)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the signature as CHUNKS longs (null if the set is empty)."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            sets, n, hashes, sigs = [], [], [], []

            def flush(sets=sets, sigs=sigs):
                full = [s for s in sets if len(s)]
                rows = iter(signature(full).view("<i8").tolist() if full else ())
                sigs.extend(next(rows) if len(s) else None for s in sets)
                sets.clear()

            for s in shingle_sets(batch.column(1)):
                sets.append(s)
                n.append(len(s))
                hashes.append(set_hashes(s))
                if sum(map(len, sets[-1:])) + 64 * len(sets) > 1 << 17:
                    flush()
            flush()
            low, high = zip(*hashes, strict=True) if hashes else ((), ())
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "sig": pa.array(sigs, pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, low long, high long, sig array<long>")


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set: with its size they name its class."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ FLIPS[0])).view(np.int64)) if len(s) else 0


def full_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, odd: DataFrame | None = None) -> DataFrame:
    """doc_id, items: the whole shingle sets of the classes that are given by their representatives (doc_id). `odd` (rep,
    first_id, and the class) has the classes whose representative isn't the id of their first document."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            items = list(shingle_sets(batch.column(1)))
            low, high = zip(*map(set_hashes, items), strict=True) if items else ((), ())
            columns = {"doc_id": batch.column(0), "n_shingles": pa.array(map(len, items), pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())}
            yield pa.record_batch(columns | {"items": pa.array([s.view(np.int64) for s in items], pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    reps = materialise(reps, "near-ids")
    made = lambda ids: rows.join(if_small(ids), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, n_shingles long, low long, high long, items array<long>")
    out = made(reps).select("doc_id", "items").dropDuplicates(["doc_id"])
    if odd is None:
        return out
    wanted = odd.join(reps.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").withColumnRenamed("first_id", "doc_id")
    more = made(wanted.select("doc_id").distinct()).join(wanted, ["doc_id", *CLASS]).dropDuplicates(["rep"])
    return out.unionByName(more.select(F.col("rep").alias("doc_id"), "items"))


def with_representatives(known: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The classes of equal sets with `rep`, their smallest id; the odd ones of them; links (a, b) of classes through an id.

    An id that has several texts is in several classes. Such an id names no class: a class that has it first is odd, and
    is named by a negative hash of the class. None and None if no id has several texts.
    """
    own = F.struct(*CLASS)
    several = known.groupBy("doc_id").agg(F.min(own).alias("least"), F.max(own).alias("most")).where("least != most").select("doc_id")
    several = materialise(several, "near-several")
    classes = known.groupBy(*CLASS).agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    if several.isEmpty():
        return materialise(classes.withColumn("rep", F.col("first_id")), "near-classes"), None, None
    named = classes.join(if_small(several.select(F.col("doc_id").alias("first_id"), F.lit(True).alias("clash"))), "first_id", "left")
    name = F.xxhash64(*CLASS).bitwiseOR(F.lit(-(1 << 63)))
    reps = materialise(named.withColumn("rep", F.when(F.col("clash"), name).otherwise(F.col("first_id"))).drop("clash"), "near-classes")
    places = known.join(if_small(several), "doc_id", "left_semi").select("doc_id", *CLASS).distinct().join(reps.select(*CLASS, "rep"), CLASS).select("doc_id", "rep")
    through = places.join(places.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a != b").distinct()
    return reps, reps.where("rep != first_id").select("rep", "first_id", *CLASS), materialise(through, "near-through")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def keys_of(sig: Column) -> Column:
    """The keys of a signature: of each chunk, the lanes but one."""
    out = []
    for c in range(CHUNKS):
        for lane in range(CHUNK):
            hole = 0xFFFF << (16 * lane)
            mask = ~hole if hole < 1 << 63 else (1 << 48) - 1
            out.append(F.xxhash64(F.get(sig, c).bitwiseAND(F.lit(mask)), F.lit(CHUNK * c + lane)))
    return F.array(*out)


def matches(a: Column, b: Column) -> Column:
    """Lanes in which two signatures agree. Each lane's bits are folded into its lowest one."""
    total = F.lit(LANES)
    for c in range(CHUNKS):
        x = F.get(a, c).bitwiseXOR(F.get(b, c))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("items_a") + F.size("items_b")).alias("sizes"))
    return joined.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b).

    Each round hooks every node to its smallest neighbour, follows the hooks, and contracts the links; the number of
    nodes at least halves. The hooks of each round are in the shared folder; at the end they are followed one after another.
    """
    edges = materialise(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    label, n = None, edges.count()
    while n:
        near = F.broadcast if 2 * n <= BROADCAST_KEYS else (lambda df: df)  # a link has two nodes at most, two longs a row
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        hook = materialise(hook.join(near(above), "up").select("node", F.col("higher").alias("up")), "cc-hooks")
        label = hook.withColumnRenamed("up", "component") if label is None else moved(label, hook, near)
        up = [near(hook.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}"))) for x in "ab"]
        short = edges.join(up[0], "a").join(up[1], "b").where("up_a != up_b")
        edges = materialise(short.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "cc-edges")
        n = edges.count()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0) if label is None else materialise(label, "cc-labels")


def moved(label: DataFrame, hook: DataFrame, near=lambda df: df) -> DataFrame:
    """The label with each component moved up a hook (node, up), where it has one."""
    step = near(hook.select(F.col("node").alias("component"), "up"))
    return label.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))


def labelled(rows: DataFrame, label: DataFrame, node: str = "rep") -> DataFrame:
    found = label.select(F.col("node").alias(node), "component")
    return rows.join(found, node, "left").withColumn("component", F.coalesce("component", node))


def large_family_links(members: DataFrame, sets: DataFrame, block: int, percent: int) -> DataFrame:
    """Links (a, b) between components within families, compared in blocks.

    members: family, rep, component. Those outside the family's largest component are held against all of the family.
    """
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("n_top"))
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    rows = members.join(top, "family").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    rows = rows.withColumns({"n_a": blocks(F.col("all") - F.col("n_top")), "n_b": blocks(F.col("all"))})
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    shape = ["family", "at_a", "at_b", "side", "rep", "component", "items"]
    outer = rows.where("component != top").withColumn("side", F.lit(0)).withColumn("at_a", place(F.col("n_a"), 1)).withColumn("at_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    every = rows.withColumn("side", F.lit(1)).withColumn("at_b", place(F.col("n_b"), 2)).withColumn("at_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)))

    def compare(table):
        import pyarrow as pa

        side = table.column("side").to_numpy()
        reps, comps = table.column("rep").to_numpy(), table.column("component").to_numpy()
        items = table.column("items").combine_chunks()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found_a, found_b = [], []
        if len(a) and len(b):
            n = items.value_lengths().to_numpy()
            flat = items.flatten().to_numpy()
            owner = np.repeat(np.arange(len(items)), n)
            _, code = np.unique(flat, return_inverse=True)
            in_a, in_b = np.zeros(code.max() + 1, bool), np.zeros(code.max() + 1, bool)
            in_a[code[side[owner] == 0]] = in_b[code[side[owner] == 1]] = True
            both = in_a & in_b
            shared = np.cumsum(both) - 1
            use = both[code]
            owner, code = owner[use], shared[code[use]]
            row = np.empty(len(items), np.int64)
            row[a], row[b] = np.arange(len(a)), np.arange(len(b))
            order = np.argsort(code, kind="stable")
            owner, code = owner[order], code[order]
            common = np.zeros((len(a), len(b)), np.float32)
            for first in range(0, int(both.sum()), 4096):
                lo, hi = np.searchsorted(code, (first, first + 4096))
                own, col = owner[lo:hi], code[lo:hi] - first
                m_a, m_b = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
                s = side[own] == 0
                m_a[row[own[s]], col[s]] = 1
                m_b[row[own[~s]], col[~s]] = 1
                common += m_a @ m_b.T
            union = n[a][:, None] + n[b][None, :] - common
            linked = (100 * common.astype(np.int64) >= percent * union.astype(np.int64)) & (comps[a][:, None] != comps[b][None, :])
            for i, j in zip(*np.nonzero(linked), strict=True):
                found_a.append((reps[a[i]], comps[b[j]]))
                found_b.append(reps[b[j]])
        once = {k: v for k, v in zip(found_a, found_b, strict=True)}
        return pa.table({"a": pa.array([k[0] for k in once], pa.int64()), "b": pa.array(list(once.values()), pa.int64())})

    return outer.select(shape).unionByName(every.select(shape)).groupBy("family", "at_a", "at_b").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, pair_limit: int = PAIR_LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (doc_id = component_id).

    One row per row of the table; other columns are ignored. A text without words, or null, has no shingle and is linked
    with nothing. Rows that repeat a doc_id and its text get equal results. An id with several texts is linked through each
    of them: all its rows are in one component. A row without an id is linked with nothing: its component_id is null and
    it stays. Very long texts are read whole, in windows. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    signed = materialise(signatures(docs, id_col, text_col), "near-signatures")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # classes of equal sets
    reps, odd, through = with_representatives(known)
    keyed = reps.select("rep", F.explode(keys_of(F.col("sig"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(keyed.join(shared, "key").select("key", "rep", "n"), "near-buckets")
    side_a = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    side_b = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    agree = matches(F.col("sig_a"), F.col("sig_b"))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    # star round: each document and the hub of its buckets that it agrees with most
    weight = met.groupBy("rep").agg(F.sum("n").alias("weight"))
    hubs = materialise(met.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub")), "near-hubs")
    seen = met.join(if_small(hubs), "key").where("rep != hub")
    spokes = seen.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    spokes = spokes.join(side_a, "a").join(side_b, "b").select("a", "b", agree.alias("lanes"), fits.alias("fits"))
    spokes = materialise(spokes, "near-spokes")
    star = spokes.where(F.col("fits") & (F.col("lanes") >= STAR_MATCHES)).groupBy("a").agg(F.max_by("b", F.struct("lanes", -F.col("b"))).alias("b"))
    star = materialise(star, "near-star")
    sets = full_sets(docs, ids_of(star), id_col, text_col, odd)
    links = materialise(confirmed(star, sets, percent), "near-links")
    label = if_small(components(links))

    # buckets that still hold more than one component; dense ones are those whose members mostly resemble their hub
    rows = labelled(met, label)
    state = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    state = materialise(state.select("key"), "near-open")
    rest = rows.join(if_small(state), "key", "left_semi")
    alike = seen.where(F.col("n") > pair_limit).join(spokes, (F.col("rep") == F.col("a")) & (F.col("hub") == F.col("b")))
    dense = alike.groupBy("key").agg((4 * F.count_if(F.col("lanes") >= MATCHES) >= F.max("n")).alias("dense"))
    rest = materialise(rest.join(dense, "key", "left").withColumn("dense", F.coalesce("dense", F.lit(False))), "near-rest")
    thin, thick = rest.where("NOT dense"), rest.where("dense")
    more = [] if through is None else [through]
    if not thin.isEmpty():
        pieces = F.ceil(F.col("n") / PIECE).cast("int")  # a large bucket is dealt out: pieces of one side meet all of the other
        own = thin.select("key", F.col("rep").alias("a"), F.col("component").alias("of_a"), F.pmod(F.xxhash64("rep"), pieces).cast("int").alias("piece"))
        others = thin.select("key", F.col("rep").alias("b"), F.col("component").alias("of_b"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        own, others = own.join(side_a, "a"), others.join(side_b, "b")
        near = (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & fits & (agree >= MATCHES)
        pairs = own.join(others, ["key", "piece"]).where(near).select("a", "b").distinct()
        tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        more.append(confirmed(pairs, full_sets(docs, ids_of(pairs), id_col, text_col, odd), percent))
    if not thick.isEmpty():
        anchors = thick.groupBy("key").agg(F.min("rep").alias("b"))
        family = components(thick.join(anchors, "key").select(F.col("rep").alias("a"), "b"))
        members = materialise(labelled(thick.select("rep", "component").distinct().withColumnRenamed("component", "own"), if_small(family)).select("rep", F.col("own").alias("component"), F.col("component").alias("family")), "near-families")
        own = full_sets(docs, members.select(F.col("rep").alias("doc_id")), id_col, text_col, odd)
        more.append(large_family_links(members, own, block, percent))
    if more:  # links between components join those
        found = reduce(DataFrame.unionByName, more)
        found = labelled(found.select(F.col("a").alias("rep"), "b"), label).select(F.col("component").alias("a"), F.col("b").alias("rep"))
        found = labelled(found, label).select("a", F.col("component").alias("b"))
        joined = components(found)
        alone = joined.join(label, "node", "left_anti").select("node", "component")
        label = if_small(materialise(moved(label, joined.withColumnRenamed("component", "up")).unionByName(alone), "near-labels"))

    of_class = labelled(reps.select(*CLASS, "rep", "first_id"), label)
    if odd is not None:  # a class's name may be no id
        of_class = of_class.join(of_class.groupBy("component").agg(F.min("first_id").alias("smallest")), "component")
        of_class = of_class.withColumn("component", F.col("smallest"))
    out = signed.join(of_class.select(*CLASS, "component"), CLASS, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with its own columns; rows without an id stay."""
    dropped = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    dropped = if_small(materialise(dropped, "near-dropped"))
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
