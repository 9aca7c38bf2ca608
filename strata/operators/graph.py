"""Commit-graph operators: reachability (G1), walks (G2), ranges (J2/U2),
common history (U3), ahead/behind status (J9) and the incremental cut (J5).

Reachability uses chain compression instead of a per-generation BFS (one job
per commit of depth) or a recursive CTE (level and row caps):

1. list ranking gives every commit its place in its unary segment, the run of
   commits between two forks of the first-parent tree: by pointer jumping in
   ~log2(longest segment) rounds of one self-join each, where ids follow time
   over the commits at which a batch of neighbours is entered only;
2. every parent keeps one continuation child, the first-parent child with the
   most first-parent descendants (heavy path), so a first-parent path changes
   chains at most log2(n) times.  Only forks have a choice, so sizes and
   choices are worked out on the segments; a second ranking, of segments,
   gives every commit ``(chain, cpos)`` - the chain's oldest commit and the
   distance to it;
3. every other edge becomes a cross edge ``(chain_a, pos_a) -> (chain_b, pos_b)``;
4. the frontier ``(ref, chain, max_pos)`` is expanded over cross edges,
   semi-naively (only improved entries expand), until nothing improves;
5. reachable commits = commits of a frontier chain with ``cpos <= max_pos``,
   joined on ``(chain, bucket)`` so a very long chain is spread over buckets.

Every round's result is written as Parquet to the session's shared checkpoint
folder and read back, so a lost executor recomputes one round, not the whole
loop, and the planner sees a file's size: ``checkpoint()`` keeps the estimate
of the plan it cuts, a product of both sides of every join, which after a few
rounds takes longer to multiply than the round to run.  A loop's tables go
when it ends.  All keys include ``repository_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import drop_path, scratch_path

R = "repository_id"


def _cut(df: DataFrame, temps: list | None = None) -> DataFrame:
    """df written and read back; its folder is noted in ``temps`` if it may go later."""
    spark = df.sparkSession
    path = scratch_path(spark, "graph")
    df.write.parquet(path)
    if temps is not None:
        temps.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark, temps: list) -> None:
    for path in temps:
        drop_path(spark, path)


class NotConverged(RuntimeError):
    pass


JUMPS = "nid bigint, jump bigint, d bigint, done boolean"


def _jumps_in_batch(batches):
    """(nid, jump, d, done) of Arrow batches (nid, nxt, w) sorted by nid: the first node
    outside its batch that each node comes to, or the tail if that lies inside (done)."""
    for batch in batches:
        nid, ends = batch.column("nid").to_numpy(zero_copy_only=False), batch.column("nxt").is_null().to_numpy(zero_copy_only=False)
        nxt, w = (batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("nxt", "w"))  # a tail has neither
        at = np.minimum(np.searchsorted(nid, nxt), len(nid) - 1)
        inside = ~ends & (nid[at] == nxt)
        to, d = np.where(inside, at, np.arange(len(nid))), np.where(inside, w, 0)
        for _ in range(len(nid).bit_length()):
            to, d = to[to], d + d[to]
        done = ends[to]
        yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(np.where(done, nid[to], nxt[to])), pa.array(d + np.where(done, 0, w[to])), pa.array(done)],
                                         ["nid", "jump", "d", "done"])


def rank(start: DataFrame, rounds: dict, ranked: DataFrame | None = None, max_rounds: int = 256, near: bool = False) -> DataFrame:
    """List ranking by pointer jumping over ``start(nid, nxt, w)``, w the
    distance to nxt, which is a node of start or of ``ranked(nid, chain, cpos)``,
    whose nodes are ranked already.  Output (nid, chain, cpos) of the start's nodes.

    With ``near``, for ids that follow time, every Arrow batch of neighbouring ids
    first follows its links as far as they stay inside, and the rounds run over
    the nodes at which a batch is entered.  The result is the same for any ids.

    A node is *done* once its jump reaches the chain's tail; done nodes leave
    the probe side (their rows stay as lookup targets), so the probe side never
    holds a hot key: the jumps of active nodes are all distinct.  Without this
    every finished node of a long chain would point at the same tail.  The
    rounds are partitions of one table, so the lookup side is one scan however
    many rounds there were."""
    spark, temps = start.sparkSession, []
    if ranked is not None:
        ranked = ranked.select("nid", "chain", F.col("cpos").cast("bigint").alias("cpos"))
    if near:
        local = start.select("nid", "nxt", F.col("w").cast("bigint").alias("w")).repartitionByRange("nid").sortWithinPartitions("nid")
        local = _cut(local.mapInArrow(_jumps_in_batch, JUMPS), temps)
        entered = _cut(local.where(~F.col("done")).select(F.col("jump").alias("nid")).distinct(), temps)
        ranked = None if ranked is None else _cut(ranked.join(entered, "nid", "left_semi"), temps)
        rows = local.join(entered, "nid", "left_semi").select("nid", "jump", "d", "done")
    else:
        rows = start.select("nid", F.coalesce("nxt", "nid").alias("jump"), F.when(F.col("nxt").isNotNull(), F.col("w")).otherwise(0).cast("bigint").alias("d"),
                            F.col("nxt").isNull().alias("done"))
    base = scratch_path(spark, "graph-rank")
    schema = T.StructType(rows.schema.fields[:3] + [T.StructField("round", T.IntegerType()), T.StructField("done", T.BooleanType())])
    for i in range(max_rounds):
        rows.write.partitionBy("done").parquet(f"{base}/round={i}")
        rounds["ranking"] = i
        table = spark.read.schema(schema).option("basePath", base).parquet(base)
        active = table.where((F.col("round") == i) & ~F.col("done"))
        if active.isEmpty():
            break
        lookup = table.where(F.col("done") | (F.col("round") == i)).select(F.col("nid").alias("jump"), F.col("jump").alias("j2"), F.col("d").alias("d2"), "done")
        if ranked is not None:
            lookup = lookup.unionByName(ranked.select(F.col("nid").alias("jump"), F.col("chain").alias("j2"), F.col("cpos").alias("d2"), F.lit(True).alias("done")))
        rows = active.select("nid", "jump", "d").join(lookup, "jump").select(
            "nid", F.col("j2").alias("jump"), (F.col("d") + F.col("d2")).alias("d"), "done")
    else:
        raise NotConverged("chain ranking did not converge")
    found = table.where("done").select("nid", F.col("jump").alias("chain"), F.col("d").alias("cpos"))
    if near:
        core = found if ranked is None else found.unionByName(ranked)
        core = core.select(F.col("nid").alias("jump"), "chain", F.col("cpos").alias("base"))
        found = local.where("done").select("nid", F.col("jump").alias("chain"), F.col("d").alias("cpos")).unionByName(
            local.where(~F.col("done")).join(core, "jump").select("nid", "chain", (F.col("d") + F.col("base")).alias("cpos")))
    out = _cut(found)
    _drop(spark, [*temps, base])
    return out


def subtree_sizes(sizes: DataFrame, jump: DataFrame, temps: list, max_rounds: int = 256) -> DataFrame:
    """(nid, size): the sum of ``sizes(nid, size)`` over each subtree of the
    forest ``jump(nid, up)``, by pointer doubling: the descendants closer than
    2^(k+1) are those closer than 2^k plus those of the descendants at
    distance 2^k."""
    for _ in range(max_rounds):
        if jump.isEmpty():
            return sizes
        below = jump.join(sizes, "nid").groupBy(F.col("up").alias("nid")).agg(F.sum("size").alias("below"))
        sizes = _cut(sizes.join(below, "nid", "left").select("nid", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), temps)
        jump = _cut(jump.join(jump.select(F.col("nid").alias("up"), F.col("up").alias("up2")), "up").select("nid", F.col("up2").alias("up")), temps)
    raise NotConverged("subtree sizes did not converge")


def chain_index(nodes: DataFrame, e0: DataFrame, rounds: dict, taken: DataFrame | None = None, ranked: DataFrame | None = None,
                max_rounds: int = 256, near: bool = False) -> tuple[DataFrame, DataFrame]:
    """Continuations (pid, child) and coordinates (nid, chain, cpos) of
    ``nodes(nid)`` with first-parent edges ``e0(nid, pid)``.

    A parent's continuation is its child with the largest subtree, the
    smallest nid among equals.  Parents may be stored nodes of
    ``ranked(nid, chain, cpos)``; those in ``taken(pid)`` have a continuation
    already and keep it, so a further child starts a chain."""
    temps: list = []
    if taken is not None:
        e0 = e0.join(taken, "pid", "left_anti")
    e0 = _cut(e0, temps)
    own = e0.join(nodes.select(F.col("nid").alias("pid")), "pid", "left_semi")  # the parent is one of the nodes
    children = _cut(own.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("child")), temps)
    unary = children.where("n = 1").select("pid", "child")
    start = nodes.select("nid").join(unary.select(F.col("child").alias("nid"), F.col("pid").alias("nxt")), "nid", "left")
    place = rank(start.select("nid", "nxt", F.lit(1).alias("w")), rounds, max_rounds=max_rounds, near=near)
    rounds["doubling"] = rounds["ranking"]
    outer = e0.join(nodes.select(F.col("nid").alias("pid")), "pid", "left_anti") if ranked is not None else None
    forks = children.where("n > 1").select("pid")
    if (outer is None or outer.isEmpty()) and forks.isEmpty():
        cont = _cut(unary)
        _drop(nodes.sparkSession, temps)
        return cont, place
    place = place.withColumnRenamed("chain", "seg").withColumnRenamed("cpos", "spos")
    # segments with something below them: a fork, whose place is the newest of its segment, or a stored node
    at = place.select(F.col("nid").alias("pid"), F.col("seg").alias("up"))
    heads = own.join(forks, "pid", "left_semi").join(at, "pid").select("nid", "pid", "up")
    if outer is not None:
        heads = heads.unionByName(outer.select("nid", "pid", F.lit(None).cast("bigint").alias("up")))
    heads = _cut(heads, temps)
    lengths = _cut(place.groupBy(F.col("seg").alias("nid")).agg(F.max("spos").alias("top")).select("nid", (F.col("top") + 1).cast("bigint").alias("size")), temps)
    sizes = subtree_sizes(lengths, heads.where("up IS NOT NULL").select("nid", "up"), temps, max_rounds)
    heavy = (heads.join(sizes, "nid").groupBy("pid", "up").agg(F.max(F.struct("size", (-F.col("nid")).alias("low"))).getField("low").alias("low"))
             .select("pid", "up", (-F.col("low")).alias("child")))
    heavy = _cut(heavy, temps)
    cont = _cut(unary.unionByName(heavy.select("pid", "child")))
    below = heavy.join(lengths.select(F.col("nid").alias("up"), "size"), "up", "left").select(
        F.col("child").alias("nid"), F.coalesce("up", "pid").alias("nxt"), F.coalesce("size", F.lit(1)).alias("w"))
    stored = None if outer is None else ranked.join(heavy.where("up IS NULL").select(F.col("pid").alias("nid")), "nid", "left_semi")
    chains = rank(lengths.select("nid").join(below, "nid", "left"), rounds, ranked=stored, max_rounds=max_rounds)
    chains = chains.select(F.col("nid").alias("seg"), "chain", F.col("cpos").alias("base"))
    index = _cut(place.join(chains, "seg").select("nid", "chain", (F.col("base") + F.col("spos")).alias("cpos")))
    _drop(nodes.sparkSession, temps)
    return cont, index


def cross_coordinates(edges: DataFrame, cont: DataFrame, index: DataFrame) -> DataFrame:
    """(src_chain, src_pos, dst_chain, dst_pos) of the ``edges(nid, pos, pid)`` that
    are no continuations; of one source and target chain only the highest
    target matters."""
    e = edges.join(cont, "pid", "left")
    # written, so that the planner knows how few they are before it deals the index
    e = _cut(e.where(~((F.col("pos") == 0) & F.coalesce(F.col("child") == F.col("nid"), F.lit(False)))).select("nid", "pid"))
    src = index.select("nid", F.col("chain").alias("src_chain"), F.col("cpos").alias("src_pos"))
    dst = index.select(F.col("nid").alias("pid"), F.col("chain").alias("dst_chain"), F.col("cpos").alias("dst_pos"))
    return e.join(src, "nid").join(dst, "pid").groupBy("src_chain", "src_pos", "dst_chain").agg(F.max("dst_pos").alias("dst_pos"))


def numbered(nodes: DataFrame, first: int = 0) -> DataFrame:
    """(repository_id, oid, nid) of the distinct ``nodes``; if they have a ``committer_time``,
    ids follow it within a repository, the largest oid first among equals: a walk's order,
    backwards.  Ranking gains from that too.  The time and other columns stay."""
    if "committer_time" in nodes.columns:
        kept = [c for c in nodes.columns if c not in (R, "oid", "committer_time")]
        nodes = nodes.groupBy(R, "oid").agg(F.min("committer_time").alias("committer_time"), *[F.max(c).alias(c) for c in kept])
        nodes = nodes.repartitionByRange(R, "committer_time").sortWithinPartitions(R, "committer_time", F.col("oid").desc())
    else:
        nodes = nodes.select(R, "oid").distinct()
    return nodes.select(R, "oid", (F.monotonically_increasing_id() + F.lit(first).cast("bigint")).alias("nid"), *nodes.columns[2:])


class CommitGraph:
    """Chain index over ``nodes(repository_id, oid)`` and
    ``edges(repository_id, oid, pos, parent_oid)`` (child -> parent).

    Nodes get a dense 64-bit id once (``monotonically_increasing_id`` over a
    checkpointed table, so it is stable); every round then shuffles and
    checkpoints longs instead of 40-character oids.  Nodes may have a
    ``committer_time``; ids then follow it, and keep further columns (``is_merge``
    for ``walk``)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, bucket: int = 4096, max_rounds: int = 256):
        self._times = nodes if "committer_time" in nodes.columns else None
        self.nodes = nodes.select(R, "oid").dropDuplicates([R, "oid"])
        self.edges = edges.select(R, "oid", "pos", "parent_oid")
        self.bucket = bucket
        self.max_rounds = max_rounds
        self._ids = None
        self._id_edges = None
        self._index = None
        self._cross = None
        self._cont = None
        self.rounds = {"doubling": 0, "ranking": 0, "frontier": 0}

    # -- dense ids -----------------------------------------------------------------
    def ids(self) -> DataFrame:
        """(repository_id, oid, nid), with the nodes' time and further columns if they have a time."""
        if self._ids is None:
            self._ids = _cut(numbered(self.nodes if self._times is None else self._times))
        return self._ids

    def id_edges(self) -> DataFrame:
        """(nid, pos, pid) for edges whose parent is a known node."""
        if self._id_edges is None:
            ids = self.ids()
            child = ids.select(R, "oid", "nid")
            parent = ids.select(R, F.col("oid").alias("parent_oid"), F.col("nid").alias("pid"))
            self._id_edges = _cut(self.edges.join(child, [R, "oid"]).join(parent, [R, "parent_oid"])
                                  .select("nid", "pos", "pid"))
        return self._id_edges

    # -- chain index ---------------------------------------------------------------
    def _build(self) -> None:
        e0 = self.id_edges().where(F.col("pos") == 0).select("nid", "pid")
        self._cont, self._index = chain_index(self.ids().select("nid"), e0, self.rounds, max_rounds=self.max_rounds, near=self._times is not None)

    def _continuations(self) -> DataFrame:
        if self._cont is None:
            self._build()
        return self._cont

    def index(self) -> DataFrame:
        """(nid, chain, cpos): chain = nid of the chain's oldest commit, cpos =
        distance to it."""
        if self._index is None:
            self._build()
        return self._index

    def cross_edges(self) -> DataFrame:
        """(src_chain, src_pos, dst_chain, dst_pos): every edge that is not a
        continuation, in chain coordinates."""
        if self._cross is None:
            self._cross = _cut(cross_coordinates(self.id_edges(), self._continuations(), self.index()))
        return self._cross

    def extend(self, new_nodes: DataFrame, new_edges: DataFrame) -> "CommitGraph":
        """Incremental index: a graph over old + new commits that ranks only
        the new ones.  Positions count from a chain's oldest commit, so
        appending commits never moves existing coordinates; existing
        continuations stay fixed (a new child of a parent that already has
        one starts a new chain and its edge becomes a cross edge).  Edges of
        old commits whose parent only arrives now (dangling before) are added
        as cross edges, so old coordinates still do not move."""
        old_ids = self.ids()
        base = old_ids.agg(F.coalesce(F.max("nid") + 1, F.lit(0))).first()[0]
        fresh = new_nodes.join(old_ids.select(R, "oid"), [R, "oid"], "left_anti")
        new_ids = _cut(numbered(fresh, base).select(R, "oid", "nid"))
        g = CommitGraph(self.nodes.unionByName(new_ids.select(R, "oid")), self.edges.unionByName(new_edges.select(R, "oid", "pos", "parent_oid")),
                        bucket=self.bucket, max_rounds=self.max_rounds)
        g._ids = _cut(old_ids.select(R, "oid", "nid").unionByName(new_ids))
        child = g._ids.select(R, "oid", "nid")
        parent = g._ids.select(R, F.col("oid").alias("parent_oid"), F.col("nid").alias("pid"))
        candidates = new_edges.select(R, "oid", "pos", "parent_oid").join(new_ids.select(R, "oid"), [R, "oid"], "left_semi")
        candidates = candidates.unionByName(self.dangling())
        fresh_edges = _cut(candidates.join(child, [R, "oid"]).join(parent, [R, "parent_oid"]).select("nid", "pos", "pid"))
        g._id_edges = _cut(self.id_edges().unionByName(fresh_edges))
        firsts = fresh_edges.where((F.col("pos") == 0) & (F.col("nid") >= base)).select("nid", "pid")
        cont, index = chain_index(new_ids.select("nid"), firsts, g.rounds, taken=self._continuations().select("pid"), ranked=self.index(), max_rounds=self.max_rounds,
                                  near="committer_time" in new_nodes.columns)
        g._cont = _cut(self._continuations().unionByName(cont))
        g._index = _cut(self.index().unionByName(index))
        g._cross = _cut(self.cross_edges().unionByName(cross_coordinates(fresh_edges, g._continuations(), g.index())))
        return g

    def dangling(self) -> DataFrame:
        """Edges whose parent is not in the node table (shallow history)."""
        parents = self.nodes.select(R, F.col("oid").alias("parent_oid"))
        return self.edges.join(parents, [R, "parent_oid"], "left_anti")

    # -- reachability ---------------------------------------------------------------
    def frontier(self, refs: DataFrame) -> DataFrame:
        """(repository_id, ref, chain, max_pos) for ``refs(repository_id, ref, target_oid)``."""
        idx = self.index()
        cross = self.cross_edges()
        temps: list = []
        # written step by step: few refs are then known to be few before the commits are dealt to meet them
        tips = _cut(refs.select(R, "ref", F.col("target_oid").alias("oid")), temps)
        tips = _cut(tips.join(self.ids().select(R, "oid", "nid"), [R, "oid"]).select(R, "ref", "nid"), temps)
        start = tips.join(idx, "nid")
        state = _cut(start.groupBy(R, "ref", "chain").agg(F.max("cpos").alias("max_pos")))
        delta = state.withColumn("prev_pos", F.lit(None).cast("bigint"))
        keys = [R, "ref", "chain"]
        for i in range(self.max_rounds):
            # joined on (chain, bucket): a chain that most refs meet is spread over its buckets
            dealt = delta.withColumn("b", F.explode(F.sequence(
                F.floor((F.coalesce("prev_pos", F.lit(-1)) + 1) / self.bucket).cast("int"), F.floor(F.col("max_pos") / self.bucket).cast("int"))))
            exp = dealt.join(cross.withColumnRenamed("src_chain", "chain").withColumn("b", F.floor(F.col("src_pos") / self.bucket).cast("int")), ["chain", "b"]).where(
                (F.col("src_pos") <= F.col("max_pos"))
                & (F.col("prev_pos").isNull() | (F.col("src_pos") > F.col("prev_pos"))))
            cand = (exp.select(R, "ref", F.col("dst_chain").alias("chain"), F.col("dst_pos").alias("cand"))
                    .groupBy(*keys).agg(F.max("cand").alias("cand")))
            imp = cand.join(state, keys, "left").where(
                F.col("max_pos").isNull() | (F.col("cand") > F.col("max_pos"))
            ).select(*keys, F.col("cand").alias("max_pos"), F.col("max_pos").alias("prev_pos"))
            imp = _cut(imp, temps)
            self.rounds["frontier"] = i + 1
            if imp.isEmpty():
                break
            state = _cut(state.join(imp.select(*keys), keys, "left_anti").unionByName(imp.select(*keys, "max_pos")))
            delta = imp
        else:
            raise NotConverged("frontier expansion did not converge")
        _drop(state.sparkSession, temps)
        return state

    def reachable(self, refs: DataFrame) -> DataFrame:
        """G1: (repository_id, ref, oid) for every commit reachable from each ref."""
        state = self.frontier(refs)
        iv = state.select(R, "ref", "chain", F.lit(-1).alias("lo"), F.col("max_pos").alias("hi"))
        return self.nodes_in(iv, [R, "ref"])

    def nodes_in(self, intervals: DataFrame, keys: list) -> DataFrame:
        """Commits with ``lo < cpos <= hi`` on each interval's chain, as ``(*keys, oid)``."""
        return self.ids_in(intervals, keys).join(self.ids().select("nid", "oid"), "nid").select(*keys, "oid")

    def ids_in(self, intervals: DataFrame, keys: list) -> DataFrame:
        """``nodes_in`` as ``(*keys, nid)``.  Joined on (chain, bucket): a long
        chain is spread over buckets and only the interval's buckets are touched,
        so the cost follows the output, not the chain length."""
        b = self.bucket
        sb = intervals.select(*keys, "chain", "lo", "hi", F.explode(F.sequence(
            F.floor((F.col("lo") + 1) / b).cast("int"), F.floor(F.col("hi") / b).cast("int"))).alias("b"))
        nb = self.index().select("chain", "nid", "cpos", F.floor(F.col("cpos") / b).cast("int").alias("b"))
        return sb.join(nb, ["chain", "b"]).where((F.col("cpos") > F.col("lo")) & (F.col("cpos") <= F.col("hi"))).select(*keys, "nid")


# --- set algebra on frontiers: per chain a ref reaches exactly positions 0..max_pos ----

def frontier_difference(front: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Per pair and chain, the positions reachable from ``a`` and not from
    ``b``: the interval (max_b, max_a] (max_b = -1 when b misses the chain).
    Output (repository_id, a, b, chain, lo, hi) with hi > lo."""
    fa = front.select(R, F.col("ref").alias(a), "chain", F.col("max_pos").alias("hi"))
    fb = front.select(R, F.col("ref").alias(b), "chain", F.col("max_pos").alias("lo"))
    x = pairs.select(R, a, b).join(fa, [R, a]).join(fb, [R, b, "chain"], "left")
    return x.select(R, a, b, "chain", F.coalesce("lo", F.lit(-1)).alias("lo"), "hi").where(F.col("hi") > F.col("lo"))


def frontier_intersection(front: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Per pair and chain, the positions reachable from both: (-1, min(max_a, max_b)]."""
    fa = front.select(R, F.col("ref").alias(a), "chain", F.col("max_pos").alias("ma"))
    fb = front.select(R, F.col("ref").alias(b), "chain", F.col("max_pos").alias("mb"))
    x = pairs.select(R, a, b).join(fa, [R, a]).join(fb, [R, b, "chain"])
    return x.select(R, a, b, "chain", F.lit(-1).alias("lo"), F.least("ma", "mb").alias("hi"))


def ahead_behind(front: DataFrame, pairs: DataFrame) -> DataFrame:
    """J9 from frontiers alone: merging ``source_ref`` into ``target_ref``,
    ahead = |reach(target) - reach(source)|, behind = the reverse - sums of
    interval lengths over (refs x chains), no commit set is materialised."""
    k = [R, "target_ref", "source_ref"]
    ahead = (frontier_difference(front, pairs, "target_ref", "source_ref")
             .groupBy(*k).agg(F.sum(F.col("hi") - F.col("lo")).alias("ahead")))
    behind = (frontier_difference(front, pairs, "source_ref", "target_ref")
              .groupBy(*k).agg(F.sum(F.col("hi") - F.col("lo")).alias("behind")))
    out = pairs.select(*k).join(ahead, k, "left").join(behind, k, "left")
    a = F.coalesce("ahead", F.lit(0)).cast("bigint")
    bh = F.coalesce("behind", F.lit(0)).cast("bigint")
    status = F.when(bh == 0, F.lit("up_to_date")).when(a == 0, F.lit("fast_forward")).otherwise(F.lit("diverged"))
    return out.select(*k, a.alias("ahead"), bh.alias("behind"), status.alias("status"))


# --- operators over the graph --------------------------------------------------------

def _is_merge(attrs: DataFrame) -> DataFrame:
    return attrs.select(R, "oid", "committer_time", (F.size("parent_oids") > 1).alias("is_merge"))


def rev_list(graph: CommitGraph, refs: DataFrame, attrs: DataFrame, limit: int | None = None,
             since: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """The walk of each ref, newest first (committer_time DESC, oid ASC):
    at most ``limit`` walked commits (merges count), stopping before the
    ref's ``since(repository_id, ref, since_oid)`` commit when the walk meets
    it, merges then dropped.  Output (repository_id, ref, oid, committer_time, walk_rank)."""
    reach = graph.reachable(refs) if reach is None else reach
    rows = reach.join(_is_merge(attrs), [R, "oid"])
    if since is not None:
        met = since.join(reach.withColumnRenamed("oid", "since_oid"), [R, "ref", "since_oid"], "left_semi")
        st = met.join(attrs.select(R, F.col("oid").alias("since_oid"), F.col("committer_time").alias("since_time")),
                      [R, "since_oid"])
        rows = rows.join(st, [R, "ref"], "left").where(
            F.col("since_oid").isNull()
            | (F.col("committer_time") > F.col("since_time"))
            | ((F.col("committer_time") == F.col("since_time")) & (F.col("oid") < F.col("since_oid")))
        ).drop("since_oid", "since_time")
    w = Window.partitionBy(R, "ref").orderBy(F.col("committer_time").desc(), F.col("oid"))
    rows = rows.withColumn("walk_rank", F.row_number().over(w))
    if limit is not None:
        rows = rows.where(F.col("walk_rank") <= limit)
    return rows.where(~F.col("is_merge")).drop("is_merge")


def walk(graph: CommitGraph, front: DataFrame, limit: int | None = None, since: DataFrame | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """``rev_list`` of the refs of a frontier, on a graph whose nodes have a
    ``committer_time`` and ``is_merge``; the rows of ``indexed(repository_id, branch,
    oid)`` are left out (J5 exact).

    Ids follow the order of the walk, so a ref's commits are cut and numbered by
    them.  Names, times and the branches on which a commit is indexed are looked up
    once a commit, before it meets its refs: no oid is shuffled for a (commit, ref)."""
    rows = graph.ids_in(front.select(R, "ref", "chain", F.lit(-1).alias("lo"), F.col("max_pos").alias("hi")), [R, "ref"])
    if since is not None:
        at = _cut(since.select(R, "ref", F.col("since_oid").alias("oid")))
        at = _cut(at.join(graph.ids().select(R, "oid", "nid"), [R, "oid"]).select(R, "ref", "nid"))
        met = at.join(graph.index(), "nid").join(front, [R, "ref", "chain"]).where(F.col("cpos") <= F.col("max_pos"))
        rows = rows.join(met.select(R, "ref", F.col("nid").alias("since")), [R, "ref"], "left").where(F.col("since").isNull() | (F.col("nid") > F.col("since"))).drop("since")
    rows = rows.withColumn("walk_rank", F.row_number().over(Window.partitionBy(R, "ref").orderBy(F.col("nid").desc())))
    if limit is not None:
        rows = rows.where(F.col("walk_rank") <= limit)
    own = graph.ids().where(~F.col("is_merge")).select(R, "nid", "oid", "committer_time")
    if indexed is not None:
        own = own.join(indexed.groupBy(R, "oid").agg(F.collect_set("branch").alias("on")), [R, "oid"], "left")
        rows = rows.join(own.drop(R), "nid").where(~F.coalesce(F.array_contains("on", F.col("ref")), F.lit(False)))
    else:
        rows = rows.join(own.drop(R), "nid")
    return rows.select(R, "ref", "oid", "committer_time", "walk_rank")


def range_from_set(only_new: DataFrame, attrs: DataFrame, limit: int | None = None) -> DataFrame:
    """J2 over an already computed ``new - old`` set (e.g. from frontier
    intervals): merges dropped, newest ``limit`` per pair."""
    diff = only_new.join(_is_merge(attrs), [R, "oid"]).where(~F.col("is_merge")).drop("is_merge")
    if limit is None:
        return diff
    w = Window.partitionBy(R, "old_ref", "new_ref").orderBy(F.col("committer_time").desc(), F.col("oid"))
    return diff.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def incremental_cut(walk: DataFrame, index: DataFrame, mode: str = "exact") -> DataFrame:
    """Which walked commits a cycle inserts for branch ``ref``.

    ``exact``: every walked commit not yet indexed on that branch (commits
    merged in later with an older time are kept).  ``cut``: only commits the
    walk meets before the newest indexed commit of the branch (W1) - pass
    that as ``since`` to ``rev_list`` and use its output; here the walk rows
    newer than the branch's newest indexed (committer_time, oid)."""
    idx = index.select(R, F.col("branch").alias("ref"), "oid", "committer_time")
    if mode == "exact":
        return walk.join(idx.select(R, "ref", "oid"), [R, "ref", "oid"], "left_anti")
    if mode != "cut":
        raise ValueError(mode)
    w = Window.partitionBy(R, "ref").orderBy(F.col("committer_time").desc(), F.col("oid"))
    newest = (idx.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
              .select(R, "ref", F.col("oid").alias("since_oid"), F.col("committer_time").alias("since_time")))
    j = walk.join(newest, [R, "ref"], "left")
    keep = (F.col("since_oid").isNull() | (F.col("committer_time") > F.col("since_time"))
            | ((F.col("committer_time") == F.col("since_time")) & (F.col("oid") < F.col("since_oid"))))
    return j.where(keep).drop("since_oid", "since_time")
