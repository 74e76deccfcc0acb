"""The trie of conversations' prefixes, from partial tries merged by the hash of a prefix, and sums over its subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import give_back, materialise, mix64, partitions, powers

#: Conversations whose first is the hub of all, and turns taken over from it at most (one less than the modulus of the checksum).
HUB, MOST_SHARED = 100, 5
#: Rows that a task combines into one partial trie, and parts of the merge before the last.
PARTIAL, FAN = 200_000, 8
#: Bytes of a piece of an end list.
PIECE = 1_000_000
#: Rates of the two polynomials that name a prefix.
_RATES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_ALL = (1 << 64) - 1
_KEY = ["depth", "k1", "k2"]


def _signed(x: int) -> int:
    x &= _ALL
    return x - (x >> 63 << 64)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _starts(keys: np.ndarray, before) -> tuple[np.ndarray, np.ndarray]:
    """Of each row where its run starts in this batch, and whether the run goes on from the batch before, which ended with key `before`."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[0] = before is None or keys[0] != before
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)), np.cumsum(new) == 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, with their place i in this partition's run of their conversation and the run's polynomials up to (a) and before (b) them."""
    part, before, n, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        start, on = _starts(conv, before)
        at = np.arange(len(conv)) - start
        columns = []
        for lane, rate in enumerate(_RATES):
            term = mix64(_u64(batch.column(f"h{lane + 1}"))) * powers(rate, len(conv))[0][at]
            total = np.cumsum(term)
            up_to = total - (total - term)[start]
            ahead = up_to - term
            if on.any():
                shift = np.uint64(pow(rate, n, 1 << 64))
                for x in (up_to, ahead):
                    x[on] = x[on] * shift + np.uint64(sums[lane])
            columns += [up_to.view(np.int64), ahead.view(np.int64)]
            sums[lane] = int(up_to[-1])
        i = at + 1 + np.where(on, n, 0)
        before, n = conv[-1], int(i[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array(np.full(len(conv), part)), pa.array(i), batch.column("h1"), batch.column("h2"), batch.column("cp"), *map(pa.array, columns)],
            ["conv", "part", "i", "h1", "h2", "cp", "a1", "b1", "a2", "b2"],
        )
    give_back()


def _broken(runs: DataFrame, key: str, values: list[str]) -> list:
    """The runs of keys that go on in the next partition: key, part, n and the values at the run's end, in order.

    A partition has at most two of them, its first and its last.
    """
    ends = sorted(runs.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    both = sorted({a.high for a, b in zip(ends, ends[1:], strict=False) if a.high == b.low})
    if not both:
        return []
    some = runs.join(F.broadcast(runs.sparkSession.createDataFrame([(k,) for k in both], f"{key} long")), key)
    return sorted(some.groupBy(key, "part").agg(F.max("i").alias("n"), *(F.max_by(v, "i").alias(v) for v in values)).collect())


def _placed(carried: dict[int, tuple]):
    """Runs as parts of whole conversations. carried: of a partition, the conversation that goes on in it, its turns and polynomials before."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, pos = (batch.column(c).to_numpy() for c in ("conv", "part", "i"))
            pos, lanes = pos.copy(), {c: _u64(batch.column(c)).copy() for c in ("a1", "b1", "a2", "b2")}
            for p in np.unique(part).tolist():
                if p in carried:
                    c, n, sums = carried[p]
                    of = (part == p) & (conv == c)
                    pos[of] += n
                    for name, x in lanes.items():
                        lane = int(name[1]) - 1
                        x[of] = x[of] * np.uint64(pow(_RATES[lane], n, 1 << 64)) + np.uint64(sums[lane])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(pos), *(batch.column(c) for c in ("h1", "h2", "cp")), *(pa.array(x.view(np.int64)) for x in lanes.values())], ["conv", "pos", "h1", "h2", "cp", *lanes]
            )

    return fn


_BASE = "shared boolean, conv long, depth long, k1 long, k2 long, p1 long, p2 long, cp long, ends boolean, skips long, size long, c1 long, m1 long, c2 long, m2 long"


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its root and the turns that it shares (as members of their nodes), and how its own turns' polynomials become keys."""
    mixed = lambda h: int(mix64(np.array([h & _ALL], np.uint64))[0])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            conv, skips, size = r["conv"], r["skips"], r["size"]
            taken = sorted(r["hub"] or [], key=lambda t: t["pos"])[:skips]
            length = len(taken) + max(size - skips, 0)
            keys, ups = [0, 0], [1, 1]
            out.append((True, conv, 0, 0, 0, None, None, 0, length == 0, 0, 0, 0, 0, 0, 0))
            for depth, t in enumerate(taken, 1):
                last = list(keys)
                for lane, rate in enumerate(_RATES):
                    keys[lane] = (keys[lane] + mixed(t[f"h{lane + 1}"]) * ups[lane]) & _ALL
                    ups[lane] = ups[lane] * rate & _ALL
                out.append((True, conv, depth, *map(_signed, keys), *map(_signed, last), t["cp"], depth == length, 0, 0, 0, 0, 0, 0))
            if size > skips:
                constants = []
                for lane, rate in enumerate(_RATES):
                    skipped = sum(mixed(t[f"h{lane + 1}"]) * pow(rate, t["pos"] - 1, 1 << 64) for t in r["head"] if t["pos"] <= skips)
                    times = pow(rate, len(taken) - skips, 1 << 64)
                    constants += [_signed(keys[lane] - times * skipped), _signed(times)]
                out.append((False, conv, len(taken), 0, 0, None, None, 0, False, skips, size, *constants))
        if out:
            kinds = [pa.bool_(), *[pa.int64()] * 7, pa.bool_(), *[pa.int64()] * 6]
            names = [f.split()[0] for f in _BASE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's own turns as members of nodes."""
    for batch in batches:
        lanes = {}
        for lane in (1, 2):
            c, m = _u64(batch.column(f"c{lane}")), _u64(batch.column(f"m{lane}"))
            lanes |= {f"k{lane}": c + m * _u64(batch.column(f"a{lane}")), f"p{lane}": c + m * _u64(batch.column(f"b{lane}"))}
        pos, size = batch.column("pos").to_numpy(), batch.column("size").to_numpy()
        depth = batch.column("depth").to_numpy() + pos - batch.column("skips").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array(depth), *(pa.array(lanes[n].view(np.int64)) for n in ("k1", "k2", "p1", "p2")), batch.column("cp"), pa.array(pos == size)],
            ["conv", "depth", "k1", "k2", "p1", "p2", "cp", "ends"],
        )


_NODE = "part long, depth long, k1 long, k2 long, p1 long, p2 long, low long, n long, cp long"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members as partial tries: a row for each node of some PARTIAL members, with its smallest one and their number."""
    part, held, n = TaskContext.get().partitionId(), [], 0

    def combined() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        col = {c: rows.column(c).to_numpy() for c in ("conv", *_KEY, "cp")}
        order = np.lexsort((col["conv"], col["k2"], col["k1"], col["depth"]))
        new = np.ones(len(order), bool)
        for c in _KEY:
            x = col[c][order]
            new[1:] &= x[1:] == x[:-1]
        new[1:] = ~new[1:]
        first = np.flatnonzero(new)
        take = pa.array(order[first])
        count = np.diff(np.append(first, len(order)))
        columns = [pa.array(np.full(len(first), part)), *(rows.column(c).combine_chunks().take(take) for c in (*_KEY, "p1", "p2", "conv")), pa.array(count), rows.column("cp").combine_chunks().take(take)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _NODE.split(", ")])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > PARTIAL:
            yield combined()
            held, n = [], 0
    if n:
        yield combined()
    give_back()


def _merged(partial: DataFrame) -> DataFrame:
    """Partial tries as one: nodes with the same key add their members, first within parts of the partial tries and then over all."""
    now = partial.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(FAN)))
    for keys in (["part", *_KEY], _KEY):
        same = [F.first(c).alias(c) for c in ("p1", "p2", "cp")]
        now = now.groupBy(*keys).agg(*same, F.min("low").alias("low"), F.sum("n").alias("n"))
    return now


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order of the node that they end at, as pieces of that node's list."""
    now, held, first, size = None, [], 0, 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in now), pa.array([first]), pa.array([",".join(held)])], [*_KEY, "first", "ids"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv")), strict=True):
            if key != now or size > PIECE:
                if held:
                    out.append(piece())
                now, held, first, size = key, [], conv, 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each list, whose pieces come in order; no list is held."""
    now, digest, done = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)), pa.array([d[1] for d in done], pa.string())], [*_KEY, "sha"])

    for rows in batches:
        for *key, ids in zip(*(rows.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(done) > 10_000:
            yield batch()
            done = []
    if now is not None:
        done.append((now, digest.hexdigest()))
        yield batch()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order of their path, deepest first, with sums over this partition's run of the path."""
    part, before, n, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        low = batch.column("low").to_numpy()
        start, on = _starts(low, before)
        found = []
        for i, c in enumerate(("leaves", "saved")):
            x = batch.column(c).to_numpy()
            total = np.cumsum(x)
            total = total - (total - x)[start] + np.where(on, sums[i], 0)
            sums[i] = int(total[-1])
            found.append(pa.array(total))
        place = np.arange(len(low)) - start + 1 + np.where(on, n, 0)
        before, n = low[-1], int(place[-1])
        keep = [c for c in batch.schema.names if c not in ("leaves", "saved")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found, pa.array(np.full(len(low), part)), pa.array(place)], [*keep, "leaves", "saved", "part", "i"])


def _members(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row for each rebuilt conversation and depth: the keys of its prefix and of the one before."""
    spark = turns.sparkSession
    n = partitions(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.length(text).cast("long").alias("cp")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    kinds = "conv long, part long, i long, h1 long, h2 long, cp long, a1 long, b1 long, a2 long, b2 long"
    runs = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("turn").mapInArrow(_runs, kinds))
    carried, now = {}, None
    for r in _broken(runs, "conv", ["a1", "a2"]):
        if now is None or now[0] != r.conv:
            now = (r.conv, 0, [0, 0])
        else:
            carried[r.part] = now
        sums = [(now[2][i] + pow(_RATES[i], now[1], 1 << 64) * (r[f"a{i + 1}"] & _ALL)) & _ALL for i in range(2)]
        now = (r.conv, now[1] + r.n, sums)
    placed = runs.mapInArrow(_placed(carried), "conv long, pos long, h1 long, h2 long, cp long, a1 long, b1 long, a2 long, b2 long")
    first = F.collect_list(F.when(F.col("pos") <= MOST_SHARED, F.struct("pos", "h1", "h2", "cp")))
    heads = placed.groupBy("conv").agg(F.max("pos").alias("size"), first.alias("head"))
    own = heads.withColumns({"to": F.col("conv") - F.col("conv") % HUB, "skips": F.crc32(F.col("conv").cast("string")) % (MOST_SHARED + 1)})
    hubs = heads.where(F.col("conv") % HUB == 0).select(F.col("conv").alias("to"), F.col("head").alias("hub"))
    bases = materialise(own.join(hubs, "to", "left").select("conv", "skips", "size", "head", "hub").mapInArrow(_bases, _BASE))
    mine = placed.where(F.col("pos") > F.crc32(F.col("conv").cast("string")) % (MOST_SHARED + 1)).drop("h1", "h2")
    keyed = mine.join(bases.where("not shared").select("conv", "depth", "skips", "size", "c1", "m1", "c2", "m2"), "conv")
    member = "conv long, depth long, k1 long, k2 long, p1 long, p2 long, cp long, ends boolean"
    names = [f.split()[0] for f in member.split(", ")]
    return materialise(keyed.mapInArrow(_keys, member).union(bases.where("shared").select(*names)))


def _subtree_totals(paths: DataFrame) -> DataFrame:
    """paths: path, up (the path that it hangs on, null at the top), leaves, saved. The sums over all paths below and itself.

    Each round a path's sums go to its ancestor twice as far up as before, so a tree of any depth takes the logarithm of it in rounds.
    """
    now = materialise(paths)
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = now.select(F.col("path").alias("up"), F.col("up").alias("next"))
        both = now.join(below, "path", "left").join(above, "up", "left")
        now = materialise(both.select("path", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return now.select("path", "leaves", "saved")


def prefix_trie(turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation is rebuilt from the first h turns of its hundred's first one and its own after its first h, h from a checksum of
    its id. Nodes are the distinct sequences of first turns (role and text), the root included.

    1. Turns are sorted by range, so a conversation of any length lies in several partitions; two polynomials over hashes of the
       turns name each prefix, and what a partition needs of those before are three numbers.
    2. Each task combines members into partial tries, which merge by the hash of the prefix in two steps. Lists of ends merge as
       pieces in order of their ids, and are hashed piece by piece.
    3. Nodes with one smallest member are a path. Sums over a path's nodes go up the tree of paths in doubling steps, then along each
       path, again by range.

    Turns come by number (null first), then by a hash of role and text. Null roles and texts are empty; rows with a null id belong to
    no conversation. Rows alike are turns of their own. Sequences equal in 128 bits count as equal. Whether a text is empty or very long makes no
    difference. Empty tables have no root; other columns aren't read.
    """
    spark = turns.sparkSession
    n = partitions(spark)
    members = _members(turns, conv_col, turn_col, role_col, text_col)
    nodes = materialise(_merged(members.mapInArrow(_partial, _NODE)))
    order = [*_KEY, "conv"]
    piece = "depth long, k1 long, k2 long, first long, ids string"
    lists = members.where("ends").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pieces, piece)
    digests = lists.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, sha string")

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"))
    full = nodes.join(kids, _KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("up"))
    columns = [*_KEY, "p1", "p2", "low", "n", "cp", "kids", "up"]
    # all nodes of depth 1 have the root as parent: one row
    deep = full.where("depth > 1").join(parents.where("depth > 1"), ["depth", "p1", "p2"])
    top = full.where("depth = 1").join(F.broadcast(parents.where("depth = 1")), ["depth", "p1", "p2"])
    tree = materialise(deep.select(*columns).union(top.select(*columns)).union(full.where("depth = 0").withColumn("up", F.lit(None).cast("long")).select(*columns)))
    own = {"leaves": (F.col("kids") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("cp")}
    heads = tree.where(F.col("up").isNull() | (F.col("up") != F.col("low")))
    sums = tree.groupBy(F.col("low").alias("path")).agg(*(F.sum(e).alias(c) for c, e in own.items()))
    totals = _subtree_totals(sums.join(heads.select(F.col("low").alias("path"), "up"), "path").select("path", "up", "leaves", "saved"))
    hung = heads.where("up is not null").select(F.col("low").alias("path"), (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).join(totals, "path")
    hung = hung.groupBy(*_KEY).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    weighed = tree.join(hung, _KEY, "left").select(*_KEY, "low", "up", "n", "kids", *((e + F.coalesce(F.col(c[0]), F.lit(0))).alias(c) for c, e in own.items()))
    by = [F.col("low"), F.col("depth").desc()]
    kinds = "depth long, k1 long, k2 long, low long, up long, n long, kids long, leaves long, saved long, part long, i long"
    runs = materialise(weighed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_sums, kinds))
    carried, now = [], None
    for r in _broken(runs, "low", ["leaves", "saved"]):
        if now is None or now[0] != r.low:
            now = (r.low, 0, 0)
        else:
            carried.append((r.part, *now))
        now = (r.low, now[1] + r.leaves, now[2] + r.saved)
    before = F.broadcast(spark.createDataFrame(carried, "part long, low long, l long, s long"))  # a row a partition at most
    found = runs.join(before, ["part", "low"], "left").join(digests, _KEY, "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias
    return found.select(
        F.col("low").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").cast("long").alias("n_convs"), F.col("kids").cast("long").alias("n_children"),
        add("leaves", "l")("n_leaves"), add("saved", "s")("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# the checksum by bits, as the oracle has no function for it
_BYTE = "list_reduce(list_concat([xor(s, b)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_BYTES = "list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda s, b: {_BYTE}), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS o, t.i, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i <= h.h UNION ALL SELECT h.c, 1, t.i, role, text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o, i) AS d, sha256(length(role) || ' ' || role || text) AS x, length(text) AS cp FROM r),
m AS (SELECT c, d, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS k, cp, d = max(d) OVER (PARTITION BY c) AS ends FROM s
      UNION ALL SELECT h.c, 0, '', 0, NOT EXISTS (FROM s WHERE s.c = h.c) FROM h),
n AS (SELECT d, k, min(c) AS low, count(*) AS n, max(cp) AS cp, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM m GROUP BY d, k),
e AS (SELECT DISTINCT a.d AS pd, a.k AS pk, b.d, b.k FROM m a JOIN m b ON a.c = b.c AND a.d = b.d - 1),
kids AS (SELECT pd AS d, pk AS k, count(*) AS kids FROM e GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
p AS (SELECT DISTINCT a.d AS pd, a.k AS pk, b.d, b.k FROM m a JOIN m b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT p.pd AS d, p.pk AS k, count(*) FILTER (w.kids = 0) AS leaves, sum((w.n - 1) * w.cp) AS saved FROM p JOIN w USING (d, k) GROUP BY 1, 2)
SELECT w.low AS conv_id, w.d AS depth, u.low AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN sums USING (d, k) LEFT JOIN e ON e.d = w.d AND e.k = w.k LEFT JOIN n u ON u.d = e.pd AND u.k = e.pk
"""
