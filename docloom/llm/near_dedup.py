"""MinHash near-dedup by a Chosen-path set similarity join.

Each document is the set of its word shingles, and its signature has COORDS minwise tokens. A tree node holds the
documents that agree on the tokens chosen on the way to it; at each node BRANCH of the coordinates are chosen by a hash
of the path, and a document goes to the child named by its token there. Nodes of at most SMALL documents are compared
exhaustively; larger ones branch again. TREES independent trees bring a pair at the threshold to the same node with a
probability of about 1 - 1e-5, and signatures pass it on with about 1 - 3e-5.

Only links that can join two components matter. The members of each node are first linked to one of them, its lead,
where their full sets allow it, and components are taken from these links: a very large group of near copies takes one
link a document. Then members of different components are compared: a few that are apart from the node's main component
with all of it, more of them among themselves, in blocks that spread over tasks. Blocks first compare signatures, and
members that have a likely partner come together once more with their texts, for the full sets decide every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, cut, list_array, mix, small, slices, struct_of, text_buffer, window_hashes, word_hashes

#: Nodes of at most SMALL documents, or with at most FEW apart from their main component, are compared exhaustively.
COORDS, TREES, BRANCH, SMALL, FEW, FIRST, DEEPEST = 128, 4, 2, 4096, 256, 2, 8
#: Documents of a block, of which two meet.
BLOCK = 1024
SEED = 20240611

_RNG = np.random.Generator(np.random.PCG64(SEED))
_TIMES = _RNG.integers(0, 2**31, (COORDS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, (COORDS, 1), dtype=np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted; of a row with fewer words, the whole sequence as one."""
    words, at = word_hashes(raw, offsets, lower=True)
    grams = window_hashes(words, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(window_hashes(words[a:b], b - a) + np.uint64(b - a) if b > a else words[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full((COORDS, 1), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(17)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        low = np.minimum(low, ((x[k : k + 2048] ^ _FLIP) * _TIMES).min(1, keepdims=True))
    return low[:, 0]


def shingle_features(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(key, n_shingles, set_a, set_b, sig, mini): two hashes of the set, its signature, and a byte of each coordinate."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            n, first, second, sigs = [], [], [], []
            for a, b in slices(offsets):
                for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    n.append(len(s))
                    first.append(s.sum(dtype=np.uint64))
                    second.append(mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64))
                    if len(s):
                        sigs.append(signature(s))
            count = np.array(n, np.int64)
            flat = np.concatenate([*sigs, np.zeros(0, np.uint32)])
            ends = np.append(0, np.cumsum(np.where(count > 0, COORDS, 0))).astype(np.int32)
            sig = list_array(flat.view(np.int32), ends, pa.int32())
            mini = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer((flat >> np.uint32(24)).astype(np.uint8))])
            cols = [batch.column(0), pa.array(count), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)), sig, mini]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_shingles", "set_a", "set_b", "sig", "mini"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, struct_of(f"`{key}` {kind}, n_shingles long, set_a long, set_b long, sig array<int>, mini binary"))


def children(path: Column, sig: Column) -> list[Column]:
    """The child nodes of a document at a node: BRANCH coordinates by a hash of the path, each with the token there."""
    out = []
    for k in range(BRANCH):
        at = F.pmod(F.xxhash64(path, F.lit(k)), F.lit(COORDS)).cast("int")
        out.append(F.xxhash64(path, at, F.element_at(sig, at + 1)))
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have den * intersection >= num * union."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("_id")).unionAll(pairs.select(F.col("b").alias("_id"))).distinct())
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    texts = texts.join(small(ids, ids.count()), F.col("_k") == F.col("_id"), "left_semi")
    left, right = texts.select(F.col("_k").alias("b"), F.col("_t").alias("_y")), texts.select(F.col("_k").alias("a"), F.col("_t").alias("_x"))
    rows = pairs.hint("merge").join(left, "b").hint("merge").join(right, "a").select("a", "b", "_x", "_y")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                raw, offsets = text_buffer(column)
                sides.append([s for a, b in slices(offsets) for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)])
            ok = []
            for x, y in zip(*sides):
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(inter > 0 and den * inter >= num * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, struct_of(f"a {kind}, b {kind}")).distinct()


def alike(num: int, den: int) -> int:
    """Agreeing coordinates from which on a pair is confirmed: 4 standard deviations under the threshold."""
    p = num / den
    return int(COORDS * p - 4 * (COORDS * p * (1 - p)) ** 0.5)


def hopeful(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, mini: pa.Array, num: int, den: int) -> np.ndarray:
    """Which members of a block have a partner in another component that they may link with."""
    order = by_component(comp)
    sig = np.frombuffer(b"".join(mini.to_pylist()), np.uint8).reshape(len(ids), COORDS)[order]
    comp, n = comp[order], n[order]
    found, least = np.zeros(len(ids), bool), alike(num, den)
    for k in range(int((comp != comp[-1]).sum())):
        at = np.flatnonzero((comp[k + 1 :] != comp[k]) & (den * np.minimum(n[k + 1 :], n[k]) >= num * np.maximum(n[k + 1 :], n[k]))) + k + 1
        at = at[(sig[at] == sig[k]).sum(1) >= least]
        found[at] = True
        found[k] |= len(at) > 0
    out = np.zeros(len(ids), bool)
    out[order] = found
    return out


def by_component(comp: np.ndarray) -> np.ndarray:
    """An order in which the largest component comes last: there is nothing to look for in it."""
    _, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    last = at == int(np.argmax(count))
    return np.argsort(last, kind="stable")


def signature_pass(rows: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """rows(block, id, comp) -> (block, id, comp): members with a likely partner. Blocks have a bounded size.

    Blocks of one component are left out first; small ones travel as lists, larger ones as groups.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = cut(rows)
    sizes = rows.groupBy("block").agg(F.count("*").alias("_k"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("block", "_k")
    rows = cut(rows.join(sizes.hint("rebalance"), "block"))
    full = lambda some: some.join(reps.select("id", "n", "mini").hint("merge"), "id")
    lists = full(rows.where("_k <= 64")).groupBy("block").agg(F.collect_list(F.struct("id", "comp", "n", "mini")).alias("members"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, ids, comps = [], [], []
            members = batch.column(1)
            for i, block in enumerate(batch.column(0).to_pylist()):
                own = members[i].values
                got = [own.field(f).to_numpy(zero_copy_only=False) for f in ("id", "comp", "n")]
                ok = hopeful(*got, own.field("mini"), num, den)
                blocks.append(np.full(int(ok.sum()), block))
                ids.append(got[0][ok])
                comps.append(got[1][ok])
            cols = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (blocks, ids, comps)]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "id", "comp"])

    def single(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        got = [table[f].to_numpy() for f in ("id", "comp", "n")]
        return table.select(["block", "id", "comp"]).filter(pa.array(hopeful(*got, table["mini"], num, den)))

    schema = struct_of(f"block long, id {kind}, comp {kind}")
    large = full(rows.where("_k > 64")).select("block", "id", "comp", "n", "mini").groupBy("block").applyInArrow(single, schema)
    return lists.mapInArrow(listed, schema).unionAll(large)


def set_pass(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """rows(block, id, comp, text) -> links (a, b) that join components, by the full sets of a block's texts."""
    kind = rows.schema["id"].dataType.simpleString()

    def linked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
        raw, offsets = text_buffer(table["text"])
        sets = [s for a, b in slices(offsets) for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)]
        order = by_component(comp)
        ids, comp, sets = ids[order], comp[order], [sets[i] for i in order]
        n = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.append(0, np.cumsum(n))
        mark = np.zeros(len(names), bool)
        left, right = [], []
        comp = comp.copy()  # links join components as they are found, so a block gives fewer links than it has members
        for k in range(len(ids) - 1):
            if not (comp[k + 1 :] != comp[k]).any():
                continue
            mark[flat[start[k] : start[k + 1]]] = True
            shared = np.concatenate([[0], np.cumsum(mark[flat[start[k + 1] :]])])
            inter = shared[start[k + 2 :] - start[k + 1]] - shared[start[k + 1 : -1] - start[k + 1]]
            mark[flat[start[k] : start[k + 1]]] = False
            at = np.flatnonzero((comp[k + 1 :] != comp[k]) & (den * inter >= num * (n[k + 1 :] + n[k] - inter))) + k + 1
            joined, first = np.unique(comp[at], return_index=True)
            left.append(np.full(len(first), ids[k]))
            right.append(ids[at[first]])
            comp[np.isin(comp, joined)] = comp[k]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("block").applyInArrow(linked, struct_of(f"a {kind}, b {kind}")).distinct()


def in_blocks(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """members(path, id, comp) of mixed(path, size, main, apart) nodes, dealt to blocks of a bounded size.

    With few members apart, the main component is dealt out and these go to all blocks; else each pair of blocks meets.
    """
    rows = members.select("path", "id", "comp").join(mixed.select("path", "size", "main", "apart").hint("merge"), "path")
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("_at", F.pmod(F.xxhash64("id"), parts).cast("int"))
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    own = F.array(F.struct(F.col("_at").alias("i"), F.col("_at").alias("j")))
    spread = F.transform(every, lambda x: F.struct(x.alias("i"), x.alias("j")))
    meet = F.transform(every, lambda x: F.struct(F.least(x, F.col("_at")).alias("i"), F.greatest(x, F.col("_at")).alias("j")))
    spots = F.when(F.col("_parts") == 1, own).when(F.col("apart") > FEW, meet).when(F.col("comp") == F.col("main"), own).otherwise(spread)
    rows = rows.withColumn("_spot", F.explode(spots))
    return rows.select(F.xxhash64("path", "_spot.i", "_spot.j").alias("block"), "id", "comp")


def near_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles long, component_id, kept boolean, n_joining_links long): one row per row of docs.

    Texts are lower-cased in A-Z and split into words; the set of a text has its distinct `size`-word shingles, the
    whole sequence if it has fewer words, and nothing if it has none. Documents whose sets have den * intersection >=
    num * union are linked; component_id is the smallest key reachable. Documents with equal sets are one node, so
    copies are never paired. n_joining_links counts the confirmed links of the document's set by which components were
    joined. It is no degree: most links between different sets of a component are neither looked for nor counted. Null and empty texts are linked with nothing and kept. A row with a null
    key has the component of an equal set with a key, else a null component, and is kept. Rows repeated
    with one key are one document. Keys are integers.
    """
    feats = cut(shingle_features(docs, size, text, key))
    own = ["n_shingles", "set_a", "set_b"]
    sets = cut(feats.where("n_shingles > 0").groupBy(*own).agg(F.min(key).alias("id"), F.any_value("sig").alias("sig"), F.any_value("mini").alias("mini")))
    reps = sets.where("id is not null").select("id", F.col("n_shingles").alias("n"), "sig", "mini")

    paths = [F.xxhash64(F.lit(SEED), F.lit(t)) for t in range(TREES)]
    for _ in range(FIRST):
        paths = [c for p in paths for c in children(p, F.col("sig"))]
    frontier = reps.select("id", F.explode(F.array_distinct(F.array(*paths))).alias("path"))
    kind = reps.schema["id"].dataType
    spark = docs.sparkSession
    links = spark.createDataFrame([], struct_of(f"a {kind.simpleString()}, b {kind.simpleString()}"))
    nodes = tree_nodes(frontier)
    members = cut(frontier.join(nodes.hint("merge"), "path").select("path", "id", "size", "lead", "sum"))
    star = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(links.unionAll(confirmed(likely(star, reps, num, den), docs, size, num, den, text, key)))
    comp = cut(components(links))

    blocks = []
    for depth in range(FIRST, DEEPEST + 1):
        placed = members.join(comp.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left").withColumn("comp", F.coalesce("component", "id")).drop("_id", "component")
        placed = cut(placed)
        parts = placed.groupBy("path", "size", "lead", "sum", "comp").agg(F.count("*").alias("k"))
        mixed = parts.groupBy("path", "size", "lead", "sum").agg(F.max_by("comp", "k").alias("main"), F.max("k").alias("k")).where("k < size")
        mixed = cut(mixed.withColumn("apart", F.col("size") - F.col("k")))
        wide = F.lit(False) if depth == DEEPEST else (F.col("apart") > FEW) & (F.col("size") > SMALL)
        once = mixed.where(~wide).groupBy("size", "lead", "sum").agg(F.min_by(F.struct("path", "main", "apart"), "path").alias("x")).select("size", "x.*")
        blocks.append(in_blocks(placed, once))
        heavy = mixed.where(wide).select("path")
        if depth == DEEPEST or heavy.isEmpty():
            break
        grown = placed.join(heavy.hint("merge"), "path", "left_semi").select("path", "id").join(reps.select("id", "sig").hint("merge"), "id")
        frontier = grown.select("id", F.explode(F.array(*children(F.col("path"), F.col("sig")))).alias("path")).distinct()
        nodes = tree_nodes(frontier)
        members = cut(frontier.join(nodes.hint("merge"), "path").select("path", "id", "size", "lead", "sum"))

    dealt = blocks[0]
    for more in blocks[1:]:
        dealt = dealt.unionAll(more)
    likely_rows = cut(signature_pass(dealt, reps, num, den))
    ids = cut(likely_rows.select(F.col("id").alias("_id")).distinct())
    count = ids.count()
    if count:
        texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(small(ids, count), F.col("id") == F.col("_id"), "left_semi")
        more = set_pass(likely_rows.join(texts, "id").select("block", "id", "comp", "text"), size, num, den)
        links = cut(links.unionAll(more))
        comp = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("_d")).groupBy("_d").agg(F.count("*").alias("n_joining_links"))
    named = sets.select(*own, "id").join(comp.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left")
    named = named.join(degree.hint("merge"), F.col("id") == F.col("_d"), "left")
    named = cut(named.select(*(F.col(c).alias(f"_{c}") for c in own), F.coalesce("component", "id").alias("_component"), F.coalesce("n_joining_links", F.lit(0)).alias("n_joining_links")))
    # equal sets may be a third of all rows: the join is one that Spark can split
    at = F.xxhash64(*own)
    rows = feats.select(key, *own).withColumn("_at", at)
    named = named.withColumn("_to", F.xxhash64("_n_shingles", "_set_a", "_set_b"))
    same = (F.col("_at") == F.col("_to")) & (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b"))
    rows = rows.join(named.hint("merge"), same, "left")
    component = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("_component"))
    kept = F.coalesce(F.col(key) == component, F.lit(True))
    return rows.select(key, "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("n_joining_links", F.lit(0)).cast("long").alias("n_joining_links"))


def tree_nodes(frontier: DataFrame) -> DataFrame:
    """frontier(path, id) -> (path, size, lead, sum) of nodes with two members at least; small equal ones once."""
    nodes = frontier.groupBy("path").agg(F.count("*").alias("size"), F.min("id").alias("lead"), F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum")).where("size > 1")
    name = F.when(F.col("size") > SMALL, F.col("path")).otherwise(F.lit(0))  # of larger ones each path branches on its own
    return cut(nodes.groupBy("size", "lead", "sum", name).agg(F.min("path").alias("path")).select("path", "size", "lead", "sum"))


def likely(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes allow a link and whose signatures agree about enough."""
    x = reps.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("sig").alias("_sa"))
    y = reps.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("sig").alias("_sb"))
    rows = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").where(F.lit(den) * F.least("_na", "_nb") >= F.lit(num) * F.greatest("_na", "_nb"))
    same = F.aggregate(F.zip_with("_sa", "_sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return rows.where(same >= alike(num, den)).select("a", "b")


def near_dedup(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their own columns: of each component those with the smallest key.

    Rows with null keys stay, and so do rows repeated with a key that stays. Keys that go are broadcast if they are few,
    so that texts are not shuffled; beyond, texts are shuffled once. Other columns of docs may have any names.
    """
    gone = cut(near_components(docs, size, num, den, text, key).where("not kept").select(F.col(key).alias("_gone")).distinct())
    side = small(gone, gone.count())
    return docs.join(side, docs[key] == side["_gone"], "left_anti")
