"""N-gram Jaccard self-join with prefix trees.

1. Each text becomes its set of word n-grams (64-bit hashes). Texts of equal sets form a class; its least id stands for it.
2. The classes' n-grams are counted over the corpus (``exchange``). An n-gram of one class alone can't be shared, so a class
   whose other n-grams are too few has no partner; what is left is put in the global order, rarest first.
3. Two linked sets share one of their first ``n - ceil(t n) + 1`` n-grams. The least class id holding such an n-gram is its
   home; a class goes once to each of its homes. Homes' classes are counted, and those of many are dealt in chunks, the home's
   own class in each.
4. Each chunk stores its sets in a trie and sends every set down it: the overlap so far is shared by all sets below a node,
   and a subtree is left when it and the remaining lengths can't reach the threshold, or when all of it is already linked.
5. Classes of chunked homes that ended in another component than the home's are sent down the tries of all its chunks.

Links are returned as spanning stars, never as all pairs of a group; components are their closure.

Defined results: a text of fewer words than n has one n-gram, the whole; a text without words or null has an empty set and
is linked with nothing; rows of one id are one node, linked by what any of them is linked with (each row has the size of its own
set); a null id is null in the result and its own component null; equal rows are each returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import exchange as X
from .components import components, cut

#: Classes of one home that are joined at once, and of those that are compared again.
CHUNK_CLASSES, REST_CLASSES = 256, 1024
SIGN = np.uint64(1 << 63)
ROWS = "bucket int, doc_id long, n long, rep long, tokens binary"
MEMBERS = "home long, doc_id long, n int, tokens binary"


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def sets(table: pa.Table, text_col: str, size: int):
    """The ascending distinct n-gram hashes of each row."""
    raw, offsets = B.text_bytes(table[text_col])
    for i, j in B.chunks(offsets):
        part = B.LOWER[raw[offsets[i] : offsets[j]]]
        starts, ends, first = B.word_spans(part, offsets[i : j + 1] - offsets[i])
        words = B.span_hashes(part, starts, ends)
        grams = B.mix(B.windows(words, size), 7)
        first = first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield B.mix(B.windows(words[a:b], b - a), 100 + b - a)
            else:
                yield words[:0]


def _signed(a: np.ndarray) -> np.ndarray:
    return (a ^ SIGN).view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(B.mix(s, 3).sum(dtype=np.uint64)), int(B.mix(s, 4).sum(dtype=np.uint64)) >> 32


class Forest:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Node:
    """A trie node: a run of tokens, the sets that end with it, the sizes below, and the component if there is one."""

    __slots__ = ("comp", "ends", "kids", "most", "run", "size")

    def __init__(self, run: np.ndarray, size: int, most: int, comp: int | None):
        self.run, self.size, self.most, self.comp, self.ends, self.kids = run, size, most, comp, [], {}


class Trie:
    """Sets in the global order; ``link`` joins a set with all stored ones it is similar to, unless joined already."""

    def __init__(self, sizes: list[int], tokens: list[np.ndarray], forest: Forest, percent: int):
        self.sizes, self.tokens, self.forest, self.percent = sizes, tokens, forest, percent
        self.root = Node(np.zeros(0, np.uint64), 1 << 60, 0, None)

    def add(self, x: int) -> None:
        t, size, at, node = self.tokens[x], self.sizes[x], 0, self.root
        while True:
            node.size, node.most = min(node.size, size), max(node.most, size)
            if node.comp is not None and self.forest.find(node.comp) != self.forest.find(x):
                node.comp = None
            if at == len(t):
                node.ends.append(x)
                return
            kid = node.kids.get(int(t[at]))
            if kid is None:
                node.kids[int(t[at])] = kid = Node(t[at:], size, size, x)
                kid.ends.append(x)
                return
            n = min(len(kid.run), len(t) - at)
            apart = np.flatnonzero(kid.run[:n] != t[at : at + n])
            same = int(apart[0]) if len(apart) else n
            if same < len(kid.run):
                upper = Node(kid.run[:same], kid.size, kid.most, kid.comp)
                kid.run = kid.run[same:]
                upper.kids[int(kid.run[0])] = kid
                node.kids[int(t[at])] = kid = upper
            at, node = at + same, kid

    def link(self, x: int) -> None:
        t, size, find = self.tokens[x], self.sizes[x], self.forest.find
        p = self.percent
        stack = [(kid, 0, 0) for kid in self.root.kids.values()]
        while stack:
            node, shared, depth = stack.pop()
            if node.comp is not None and find(node.comp) == find(x):
                continue
            if node.most * 100 < p * size or size * 100 < p * node.size:
                continue
            run = node.run
            at = np.searchsorted(t, run)
            shared += int((t[np.minimum(at, size - 1)] == run).sum())
            depth += len(run)
            for y in node.ends:
                if 100 * shared >= p * (size + self.sizes[y] - shared):
                    self.forest.join(x, y)
            rest = min(size - int(np.searchsorted(t, run[-1], "right")), node.most - depth)
            best = shared + rest
            if node.kids and 100 * best >= p * (size + max(node.size, depth) - best):
                stack += [(kid, shared, depth) for kid in node.kids.values()]
            if node.comp is None:
                below = {None if k.comp is None else find(k.comp) for k in node.kids.values()} | {find(y) for y in node.ends}
                if len(below) == 1 and None not in below:
                    node.comp = below.pop()


def join_chunk(ids: np.ndarray, sizes: list[int], tokens: list[np.ndarray], percent: int, comps: list | None = None) -> list[tuple[int, int]]:
    """Spanning pairs (larger id, smaller id) of the links among the sets; comps: components that are known already."""
    order = np.lexsort(([t.tobytes() for t in tokens], ids, np.array(sizes))) if len(ids) else np.zeros(0, np.int64)
    forest = Forest(len(order))
    sizes, tokens, ids = [sizes[i] for i in order], [tokens[i] for i in order], ids[order]
    if comps is not None:
        first: dict = {}
        for i, c in enumerate([comps[i] for i in order]):
            forest.join(i, first.setdefault(c, i))
    trie = Trie(sizes, tokens, forest, percent)
    for x in range(len(order)):
        if x and ids[x] == ids[x - 1] and np.array_equal(tokens[x], tokens[x - 1]):
            continue
        trie.link(x)
        trie.add(x)
    least: dict[int, int] = {}
    for i in range(len(order)):
        r = forest.find(i)
        least[r] = min(least.get(r, int(ids[i])), int(ids[i]))
    return sorted({(int(ids[i]), least[r]) for i in range(len(order)) if int(ids[i]) > least[r := forest.find(i)]})


def ngram_rows(docs: DataFrame, buckets: int, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """ROWS: for each document its set's size and class; for classes that may have a partner their ordered set."""
    parts = max(1, buckets // 2)
    coarse = X.coarse(parts)
    bits = min(64, 33 + max(1, (parts - 1).bit_length()))
    dealt = X.dealt(docs, buckets, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), id_col=id_col, text_col=text_col)

    def digests(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], list[int]] = {}
        for i, s in zip(B.ordered_ids(table["doc_id"]).tolist(), sets(table, "text", size), strict=True):
            if len(s):
                a = seen.setdefault(_digest(s), [i, i])
                a[0], a[1] = min(a[0], i), max(a[1], i)
        keys = sorted(seen)
        column = lambda f: np.array([f(k) for k in keys], np.uint64)
        return X.send(table["bucket"][0].as_py(), column(lambda k: k[0]), coarse, column(lambda k: seen[k][0]), column(lambda k: k[1]))

    def classes(keys: np.ndarray, owner: np.ndarray, least: np.ndarray, check: np.ndarray):
        order = np.lexsort((check, keys))
        k, c = keys[order], check[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
        rep = np.empty_like(least)
        rep[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(k))))
        return np.ones(len(keys), bool), rep, check

    def represented(table: pa.Table, back: pa.Table):
        """(row, set, its class: representative, and is this the first row that is to stand for it?) for each row; or None."""
        keys, rep, check = X.answered(back)
        reps = dict(zip(zip(keys.tolist(), check.tolist(), strict=True), rep.tolist(), strict=True))
        ids, done = B.ordered_ids(table["doc_id"]).tolist(), set()
        for i, s in enumerate(sets(table, "text", size)):
            digest = _digest(s) if len(s) else None
            first = digest is not None and reps[digest] == ids[i] and digest not in done  # an id may stand for several classes
            if first:
                done.add(digest)
            yield i, s, reps[digest] if len(s) else None, first

    def counts(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.send(0, np.zeros(0, np.uint64), coarse)
        own = [np.zeros(0, np.uint64), *(s for _, s, _, first in represented(table, back) if first)]
        keys, n = np.unique(np.concatenate(own), return_counts=True)
        return X.send(table["bucket"][0].as_py(), keys, coarse, np.minimum(n, 255).astype(np.uint64), bits=bits)

    def frequent(keys: np.ndarray, owner: np.ndarray, n: np.ndarray, _):
        group, k = X.groups(keys)
        total = np.bincount(group, n.astype(float), k)
        return (total >= 2)[group], np.minimum(total, 255).astype(np.uint64)[group], None

    def ordered(table: pa.Table, back: pa.Table) -> pa.Table:
        ids = B.ordered_ids(table["doc_id"])
        null = table["doc_id"].is_null().to_pylist()
        known = back["known"].to_numpy(zero_copy_only=False).astype(bool)
        keys, df, _ = X.answered(back.filter(pa.array(~known)))
        out: dict[str, list] = {k: [] for k in ("bucket", "doc_id", "n", "rep", "tokens")}
        for i, s, rep, first in represented(table, back.filter(pa.array(known))):
            rep = int(ids[i]) if rep is None else rep
            tokens = None
            if first:
                at = X.find(keys, s >> np.uint64(64 - bits))
                if 100 * int((at >= 0).sum()) >= percent * len(s):
                    n = np.where(at >= 0, df[at] if len(df) else 1, 1).astype(np.uint64)
                    tokens = np.sort(n << np.uint64(56) | s >> np.uint64(8)).tobytes()
            out["bucket"].append(table["bucket"][i].as_py()), out["n"].append(len(s)), out["tokens"].append(tokens)
            out["doc_id"].append(None if null[i] else int(_signed(ids[i : i + 1])[0]))
            out["rep"].append(None if null[i] else int(_signed(np.array([rep], np.uint64))[0]))
        return X.batch(out, [("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("tokens", pa.binary())])

    known = X.merge(dealt.groupBy("bucket").applyInArrow(digests, X.SENT), classes, parts)
    common = X.merge(dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(counts, X.SENT), frequent, parts, bits)
    back = known.withColumn("known", F.lit(True)).unionByName(common.withColumn("known", F.lit(False)))
    return dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(ordered, ROWS)


def _prefix(n: int, tokens: bytes, percent: int) -> np.ndarray:
    t = np.frombuffer(tokens, np.uint64)[: n - _least(n, percent) + 1]
    return t[t >= np.uint64(2 << 56)]


def members(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """MEMBERS: each class that may have a partner at each of its homes."""
    coarse = X.coarse(parts)
    kept = rows.where("tokens IS NOT NULL AND doc_id IS NOT NULL").select("bucket", "doc_id", "n", "tokens")

    def prefixes(table: pa.Table) -> pa.Table:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, n, t in zip(B.ordered_ids(table["doc_id"]), table["n"].to_pylist(), table["tokens"].to_pylist(), strict=True):
            keys.append(B.mix(_prefix(n, t, percent), 5)), ids.append(np.full(len(keys[-1]), i))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        if not len(keys):
            return X.send(0, keys, coarse)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return X.send(table["bucket"][0].as_py(), keys[first], coarse, np.minimum.reduceat(ids, first), np.diff(np.append(first, len(keys))).astype(np.uint64))

    def homes(keys: np.ndarray, owner: np.ndarray, least: np.ndarray, n: np.ndarray):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        spread = lambda v: np.repeat(v, np.diff(np.append(first, len(k))))
        home, total = np.empty_like(least), np.empty_like(n)
        home[order], total[order] = spread(np.minimum.reduceat(least[order], first)), spread(np.add.reduceat(n[order], first))
        return total >= 2, home, total

    def place(table: pa.Table, back: pa.Table) -> pa.Table:
        keys, home, _ = X.answered(back)
        out: dict[str, list] = {k: [] for k in ("home", "doc_id", "n", "tokens")}
        for doc, n, t in zip(table["doc_id"].to_pylist(), table["n"].to_pylist(), table["tokens"].to_pylist(), strict=True):
            at = X.find(keys, B.mix(_prefix(n, t, percent), 5))
            for h in _signed(np.unique(home[at[at >= 0]])).tolist():
                out["home"].append(h), out["doc_id"].append(doc), out["n"].append(n), out["tokens"].append(t)
        return X.batch(out, [("home", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

    back = X.merge(kept.groupBy("bucket").applyInArrow(prefixes, X.SENT), homes, parts)
    return kept.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(place, MEMBERS)


def _joined(percent: int):
    def run(table: pa.Table) -> pa.Table:
        comps = table["comp"].to_pylist() if "comp" in table.column_names else None
        tokens = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
        pairs = join_chunk(table["doc_id"].to_numpy(), table["n"].to_pylist(), tokens, percent, comps)
        return pa.table({"hi": pa.array([a for a, _ in pairs], pa.int64()), "lo": pa.array([b for _, b in pairs], pa.int64())})

    return run


def chunked(held: DataFrame) -> DataFrame:
    """``held`` with ``of``, how many chunks its home has, and ``chunk``; a home's own classes are in all."""
    large = held.groupBy("home").agg(F.ceil(F.count("*") / F.lit(CHUNK_CLASSES)).cast("int").alias("of")).where("of > 1")
    each = _salted(held, large, "home", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    every = F.when(F.col("doc_id") == F.col("home"), F.sequence(F.lit(0), F.col("of") - 1))
    return each.withColumn("chunk", F.explode(F.coalesce(every, F.array(F.pmod(F.xxhash64("doc_id"), F.col("of")).cast("int")))))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: the size of its set of ``size``-word n-grams, and the least id
    reachable by links, that is by Jaccard similarities of ``percent`` hundredths or more."""
    buckets = X.bucket_count(docs, text_col)
    rows = cut(ngram_rows(docs, buckets, id_col, text_col, size, percent))
    held = cut(chunked(cut(members(rows, percent, max(1, buckets // 2)))))
    edges = held.groupBy("home", "of", "chunk").applyInArrow(_joined(percent), "hi long, lo long")
    of_id = rows.where("doc_id IS NOT NULL").select("doc_id", "rep")  # rows of one id that are of different classes
    several = of_id.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("doc_id", "least")
    same = of_id.join(several, "doc_id").where("rep > least").select(F.col("rep").alias("hi"), F.col("least").alias("lo"))
    comps = cut(components(edges.unionByName(same)))
    if held.where("of > 1").limit(1).count():
        comps = cut(components(edges_of(comps).unionByName(_rest(held, comps, percent))))
    found = rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def edges_of(comps: DataFrame) -> DataFrame:
    return comps.where("node > component").select(F.col("node").alias("hi"), F.col("component").alias("lo"))


def _salted(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join with a small table, a row for each key at most, whose keys may hold many rows."""
    each = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(each, [key, "__salt"], how).drop("__salt")


def _rest(held: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links that chunking may have missed: classes of chunked homes whose component isn't the home's are compared with
    all of the home, chunk by chunk; none, if every such home is one component."""
    big = held.where("of > 1").groupBy("home").agg(F.ceil(F.max("of") * F.lit(CHUNK_CLASSES) / F.lit(REST_CLASSES)).cast("int").alias("chunks"))
    big = big.join(comps.withColumnRenamed("node", "home").withColumnRenamed("component", "home_comp"), "home", "left")
    once = held.where("of > 1 AND (doc_id <> home OR chunk = 0)").drop("of", "chunk")  # a home's own classes are in each of its chunks
    all_ = _salted(once, cut(big), "home").join(comps.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "comp"), "doc_id", "left")
    all_ = all_.withColumn("comp", F.coalesce("comp", "doc_id")).withColumn("minor", F.col("comp") != F.coalesce("home_comp", "home"))
    all_ = cut(all_.select("home", "chunks", "doc_id", "n", "tokens", "comp", "minor"))
    minors = cut(all_.where("minor").groupBy("home").agg(F.ceil(F.count("*") / F.lit(REST_CLASSES)).cast("int").alias("lots")))
    if not minors.limit(1).count():
        return held.sparkSession.createDataFrame([], "hi long, lo long")
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    all_ = _salted(all_, minors, "home")
    each = all_.select("home", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), deal(F.col("chunks")).alias("chunk"), "doc_id", "n", "tokens", "comp")
    few = all_.where("minor").select("home", deal(F.col("lots")).alias("lot"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", "n", "tokens", "comp")
    return each.unionByName(few).groupBy("home", "lot", "chunk").applyInArrow(_joined(percent), "hi long, lo long")
