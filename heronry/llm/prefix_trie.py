"""Conversation prefix trie: which turns conversations share, and what computing shared turns once saves.

Conversations become paths of turn digests (texts are never shuffled), and equal paths become one
row with its members counted, so a conversation told a million times is one path. Paths are dealt by
the digest of their first turn, buckets of such groups become pointer dictionary tries inside
``applyInPandas``, and an iterative postorder sums every subtree. A group with more turns than a
task should hold is not built: the turns that all its paths share are taken off as a chain of nodes
(the common prefix of its least and its greatest path), and the rest is dealt anew by the next turn,
again and again. Sums of the finished groups then climb these chains, one round for each time that
groups were dealt anew.

Defined results: rows without a conv_id are left out; a null role or text is empty; turns of one
number are ordered by the digest of role and text, and repeated rows are turns of their own. An
empty table gives no rows. Columns other than the four named are not read. The digests of a single
conversation (20 bytes a turn) are held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.runtime import free, materialize

#: Turns that a group of paths, and on average a bucket of groups, may have in one task.
MOST_TURNS = 4000
#: Conversations are rebuilt in families of so many neighbouring ids, sharing fewer turns than ``HEADS``.
FAMILY = 20
HEADS = 4
#: Ids of members are joined to text in runs of so many possible ids.
ID_RUN_BITS = 12

_WORD = r"[^\x20\x09-\x0D]+"
ROOT = ""
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """20 bytes: a digest of role and text, then the number of words."""
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(_WORD))), 8, "0")
    return F.unhex(F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), words))


def words_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 17, 4)), 16, 10).cast("long")


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of every conversation in order, each as its ``turn_key``."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_key(empty("role"), empty("text")).alias("key")).alias("t"))
    # of a struct with a null field that field comes first
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", F.col("ts.key").alias("path"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Every conversation with its first turns replaced by those of the head of its family."""
    head = paths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head_id"), F.slice("path", 1, HEADS).alias("head"))
    joined = paths.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, "head_id", "left")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = joined.select("conv_id", "path", "head", shared.alias("h"))
    taken = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest("h", F.lit(1)))).otherwise(F.array().cast("array<binary>"))
    return joined.select("conv_id", F.concat(taken, F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, n, min_id, ends): every different path with its number of members, the least, and their digest.

    Members of a path are joined to text in runs of neighbouring ids, so a path with a third of
    all conversations is a few long strings; one task puts these through SHA-256 in order and
    holds one of them at a time.
    """
    named = convs.select("conv_id", F.md5(F.concat_ws("", F.transform("path", F.hex))).alias("pid"))
    run = F.shiftright("conv_id", ID_RUN_BITS).alias("run")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = named.groupBy("pid", run).agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("min_id"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, least, sha = None, 0, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([least], pa.int64()), "n": pa.array([n], pa.int64()), "ends": [sha.hexdigest()]})

        for batch in batches:
            done = []
            for pid, ids, more, first in zip(*(batch.column(c) for c in ("pid", "ids", "n", "min_id"))):
                if pid.as_py() != now:
                    if now is not None:
                        done.append(row())
                    now, n, least, sha = pid.as_py(), 0, first.as_py(), hashlib.sha256()
                sha.update((b"," if n else b"") + ids.as_py().encode())
                n += more.as_py()
            yield from done
        if now is not None:
            yield row()

    members = runs.repartition("pid").sortWithinPartitions("pid", "run").mapInArrow(digest, "conv_id long, n long, ends string")
    return convs.join(members, "conv_id").select("path", "n", F.col("conv_id").alias("min_id"), "ends")


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the groups of one bucket: rows of (parent_gid, gid, done, path, n, min_id, ends).

    ``done`` turns of a path were taken off before; the next one is the top of its group, and only
    tops have a ``parent_gid``.
    """
    tops: dict[str, int] = {}
    above_top: dict[int, str] = {}
    below: list[dict[bytes, int]] = []  # of each node: turn -> node
    parent, depth, words, n, least, ends = [], [], [], [], [], []

    def child(of: dict, key, above: int, at: int, turn: bytes) -> int:
        node = of.get(key)
        if node is None:
            node = of[key] = len(parent)
            below.append({})
            parent.append(above)
            depth.append(at)
            words.append(int.from_bytes(turn[16:], "big"))
            n.append(0)
            least.append(None)
            ends.append(NO_ENDS)
        return node

    for parent_gid, gid, done, path, members, first, digest in zip(*(rows[c] for c in ("parent_gid", "gid", "done", "path", "n", "min_id", "ends"))):
        node = -1
        for at in range(int(done), len(path)):
            turn = bytes(path[at])
            node = child(tops, gid, -1, at + 1, turn) if node < 0 else child(below[node], turn, node, at + 1, turn)
            n[node] += int(members)
            least[node] = int(first) if least[node] is None else min(least[node], int(first))
        ends[node] = digest
        above_top[tops[gid]] = parent_gid
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for top in tops.values():
        stack = [(top, iter(below[top].values()))]
        while stack:  # postorder: a node is summed when its last child is
            node, rest = stack[-1]
            following = next(rest, None)
            if following is not None:
                stack.append((following, iter(below[following].values())))
                continue
            stack.pop()
            leaves[node] += not below[node]
            saved[node] += (n[node] - 1) * words[node]
            if parent[node] >= 0:
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
    columns = [least, depth, [least[p] if p >= 0 else None for p in parent], n, [len(b) for b in below], leaves, saved, ends]
    made = pd.DataFrame(dict(zip(COLUMNS, columns)) | {"parent_gid": [above_top.get(node) for node in range(len(parent))]})
    return made.astype({"parent_conv_id": "Int64"})


def _common(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two arrays; with the least and greatest path of a group, that of the group."""
    first = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(first > 0, first - 1).otherwise(F.size(lo)).cast("int")


def nodes(paths: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of the trie of ``distinct_paths``, as ``NODE``."""
    chains: list[DataFrame] = []  # one table for each round: groups that were dealt anew
    tries: list[DataFrame] = []
    kept: list[DataFrame] = []
    whole = paths.groupBy().agg(F.sum("n").alias("n"), F.min("min_id").alias("min_id"), F.max(F.when(F.size("path") == 0, F.col("ends"))).alias("ends")).where("n IS NOT NULL")
    root = materialize(whole.select(F.lit(ROOT).alias("gid"), F.lit(None).cast("string").alias("parent_gid"), F.lit(0).alias("done"), F.lit(0).alias("common"), F.array().cast("array<binary>").alias("path"), "n", "min_id", "ends"), "trie-root")
    chains.append(root)
    active = paths.select(F.lit(ROOT).alias("parent_gid"), F.lit(0).alias("done"), "path", "n", "min_id", "ends")
    while True:
        # a group is named by the digest of all turns up to its first own one
        keyed = active.where(F.size("path") > F.col("done")).withColumn("gid", F.md5(F.concat(F.col("parent_gid"), F.hex(F.element_at("path", F.col("done") + 1)))))
        sizes = keyed.groupBy("gid").agg(F.sum(F.size("path") - F.col("done")).alias("turns"))
        dealt = materialize(keyed.join(sizes, "gid"), "trie-dealt")
        kept.append(dealt)
        small = dealt.where(F.col("turns") <= most)
        total = small.agg(F.sum(F.size("path") - F.col("done")).alias("t")).first()["t"] or 0
        bucket = F.pmod(F.xxhash64("gid"), F.lit(-(-total // most) or 1)).alias("bucket")
        made = small.select(bucket, "parent_gid", "gid", "done", "path", "n", "min_id", "ends").groupBy("bucket").applyInPandas(build_tries, NODE + ", parent_gid string")
        tries.append(materialize(made, "trie-nodes"))
        large = dealt.where(F.col("turns") > most)
        if large.isEmpty():
            break
        ends_here = F.max(F.when(F.col("size") == F.col("common"), F.col("ends")))
        spans = large.groupBy("gid").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).select("gid", "lo", _common(F.col("lo"), F.col("hi")).alias("common"))
        spread = materialize(large.withColumn("size", F.size("path")).join(spans, "gid"), "trie-spread")
        kept.append(spread)
        chain = spread.groupBy("gid", "parent_gid", "done", "common").agg(F.sum("n").alias("n"), F.min("min_id").alias("min_id"), ends_here.alias("ends"), F.first(F.slice("lo", F.col("done") + 1, F.col("common") - F.col("done"))).alias("path"))
        chains.append(materialize(chain, "trie-chains"))
        active = spread.select(F.col("gid").alias("parent_gid"), F.col("common").alias("done"), "path", "n", "min_id", "ends")
    free(*kept)
    return _climb(chains, tries)


def _climb(chains: list[DataFrame], tries: list[DataFrame]) -> DataFrame:
    """All nodes, with the sums of finished groups carried up the chains above them, deepest round first."""
    out = tops = None
    for i in reversed(range(len(chains))):
        chain, trie = chains[i], tries[i]
        own = trie.where(F.col("parent_gid").isNotNull()).select("parent_gid", "n_leaves", "saved_tokens")
        tops = own if tops is None else own.unionByName(tops)
        sums = tops.groupBy(F.col("parent_gid").alias("gid")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        number = lambda c, none: F.coalesce(c, F.lit(none).cast("long")).alias(c)
        summed = chain.join(sums, "gid", "left").select(*chain.columns, number("n_children", 0), number("n_leaves", 1), number("below", 0))
        words = F.aggregate(F.transform("path", words_of), F.lit(0).cast("long"), lambda a, b: a + b)
        done = materialize(summed.withColumn("saved_tokens", F.col("below") + (F.col("n") - 1) * words), "trie-summed")
        tops = done.where(F.col("parent_gid").isNotNull()).select("parent_gid", "n_leaves", "saved_tokens")
        least = chain.select(F.col("gid").alias("parent_gid"), F.col("min_id").alias("top_parent"))
        named = trie.join(least, "parent_gid", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_parent"))
        spelled = _chain_nodes(done, chains[i - 1]) if i else _root_node(done)
        made = named.select(COLUMNS).unionByName(spelled)
        out = made if out is None else out.unionByName(made)
    return out


def _root_node(chain: DataFrame) -> DataFrame:
    ends = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    return chain.select(F.col("min_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", ends)


def _chain_nodes(chains: DataFrame, above: DataFrame) -> DataFrame:
    """A node for each turn of the chains; members and leaves of a chain's nodes are the same."""
    least = above.select(F.col("gid").alias("parent_gid"), F.col("min_id").alias("top_parent"))
    rows = chains.join(least, "parent_gid").select("*", F.posexplode("path").alias("at", "turn"))
    last = F.col("at") == F.size("path") - 1
    under = F.sum(words_of(F.col("turn"))).over(Window.partitionBy("gid").orderBy(F.col("at").desc()))
    return rows.select(
        F.col("min_id").alias("conv_id"), (F.col("done") + F.col("at") + 1).cast("long").alias("depth"),
        F.when(F.col("at") == 0, F.col("top_parent")).otherwise(F.col("min_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n") - 1) * under).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def trie(turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text), a row for each node."""
    convs = materialize(rebuilt(conversation_paths(turns)), "trie-convs")
    paths = materialize(distinct_paths(convs), "trie-paths")
    return nodes(paths, most)
