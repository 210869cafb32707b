"""The prefix trie of rebuilt conversations, rolled up by centroid decomposition.

A prefix is named by a polynomial hash of its turns, so that the name of a conversation's prefix follows
from names of its parts: turns are sorted across all tasks, each task names the prefixes of its own rows,
and what earlier tasks had of a conversation that goes on is put in front. No task needs a whole one.

The weight of a node is the number of its members, so the weight of a subtree is known from the members'
lengths alone. A component is the part of the forest under its top. Its centroid is the deepest node with
more than half its weight; the nodes above that have as much are the path to the top. Cutting there leaves
components of at most half the weight: one under each child, and what is left under the top. What hangs
under the centroid adds up, and goes to each node of the path. A component of few turns is gathered in a
task, which goes on in the same way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, written

# A prefix is a number below a prime, the one before it times the base plus the turn.
PRIME = 2**127 - 1
BASE = 0x5BD1E9955BD1E995C2B2AE3D27D4EB4F
# Conversations in a row share a start of at most HEADS - 1 turns of the first of them.
FAMILY, HEADS = 100, 6
# Turns (counted for each member) in a component that one task finishes.
LIMIT = 50_000
ROOT = bytes(16)


def _named(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _number(name: bytes) -> int:
    return int.from_bytes(name, "big")


def _arrays(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


NAMED = "conv long, at long, name binary, before binary, chars long"


def _local_names(conversations: DataFrame) -> DataFrame:
    """``NAMED`` and ``part``: turns in order, each prefix named as if the task's first turn of the
    conversation were its first of all."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = F.col("turn").asc_nulls_first()
    # Tasks are cut by the start of the text, which orders as the text does, so that bounds stay small.
    ordered = turns.repartitionByRange("conv", turn, "role", F.substring("text", 1, 64))
    ordered = ordered.sortWithinPartitions("conv", turn, "role", "text").select("conv", "role", "text")

    def run(frames):
        part, conv, at, value = TaskContext.get().partitionId(), None, 0, 0
        for batch, convs, roles, texts in batches(frames, "conv", "role", "text"):
            rows = []
            for c, role, text in zip(convs, roles, texts):
                if c != conv:
                    conv, at, value = c, 0, 0
                role = role.encode()
                turn = xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "big") + role + text.encode())
                before, value, at = value, (value * BASE + turn + 1) % PRIME, at + 1
                rows.append((at, _named(value), _named(before), len(text)))
            at_, names, befores, chars = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"), pa.array(at_, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(befores, pa.binary()), pa.array(chars, pa.int64()),
                    pa.array([part] * len(rows), pa.int32()),
                ],
                ["conv", "at", "name", "before", "chars", "part"],
            )

    return ordered.mapInArrow(run, f"{NAMED}, part int")


def _in_front(frames):
    """Puts ``front`` in front of ``name`` and ``before``, once ``behind`` is taken from there.
    ``steps`` is the number of turns of ``name`` after that."""
    for batch in frames:
        columns = [batch.column(c).to_pylist() for c in ("name", "before", "front", "behind", "steps")]
        names, befores = [], []
        for name, before, front, behind, steps in zip(*columns):
            change = (_number(front) - _number(behind)) % PRIME
            last = change * pow(BASE, steps - 1, PRIME)
            befores.append(_named((_number(before) + last) % PRIME))
            names.append(_named((_number(name) + last * BASE) % PRIME))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("at"), pa.array(names, pa.binary()), pa.array(befores, pa.binary()),
             batch.column("chars")],
            ["conv", "at", "name", "before", "chars"],
        )


def named_turns(conversations: DataFrame) -> DataFrame:
    """``NAMED``: every turn with its place in the conversation and the names of the prefixes that end
    with it and before it."""
    local = written(_local_names(conversations), "trie-local")
    ends = local.groupBy("conv", "part").agg(F.max(F.struct("at", "name")).alias("end"))
    end = F.struct("part", F.col("end.at").alias("at"), F.col("end.name").alias("name"))
    split = ends.groupBy("conv").agg(F.sort_array(F.collect_list(end)).alias("ends")).where(F.size("ends") > 1)
    carried = []
    # At most two rows for each task that sorted.
    for row in split.toLocalIterator():
        at, value = 0, 0
        for end in row["ends"]:
            if at:
                carried.append((row["conv"], end["part"], at, _named(value)))
            at, value = at + end["at"], (value * pow(BASE, end["at"], PRIME) + _number(end["name"])) % PRIME
    if not carried:
        return local.drop("part")
    carry = local.sparkSession.createDataFrame(carried, "conv long, part int, more long, front binary")
    rest = local.join(F.broadcast(carry.select("conv", "part")), ["conv", "part"], "left_anti").drop("part")
    later = local.join(F.broadcast(carry), ["conv", "part"]).select(
        "conv", (F.col("at") + F.col("more")).alias("at"), "name", "before", "chars", "front",
        F.lit(ROOT).alias("behind"), F.col("at").alias("steps"),
    )
    return rest.unionByName(later.mapInArrow(_in_front, NAMED))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``(conv, depth, node, parent, chars, length)``: the nodes that each rebuilt conversation passes,
    from the root on."""
    turns = written(named_turns(conversations), "trie-turns")
    first = F.col("conv") - F.col("conv") % FAMILY
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    own = turns.groupBy("conv").agg(
        F.max("at").alias("turns"),
        F.coalesce(F.max(F.when(F.col("at") == shared, F.col("name"))), F.lit(ROOT)).alias("behind"),
    )
    # At most HEADS - 1 turns each.
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("at") < HEADS)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("at", "name", "before", "chars"))).alias("heads")
    )
    heads = heads.withColumnRenamed("conv", "first")
    n = F.least(shared, F.coalesce(F.size("heads"), F.lit(0))).cast("long")
    joined = own.withColumn("first", first).join(heads, "first", "left").select(
        "conv", shared.alias("shared"), F.when(F.col("heads").isNull(), 0).otherwise(n).alias("n"), "behind",
        "heads", F.greatest(F.col("turns") - shared, F.lit(0)).alias("after"),
    )
    convs = written(
        joined.withColumns(
            {
                "front": F.when(F.col("n") > 0, F.col("heads")[F.col("n").cast("int") - 1]["name"]).otherwise(F.lit(ROOT)),
                "heads": F.when(F.col("n") > 0, F.slice("heads", F.lit(1), F.col("n").cast("int"))),
                "length": F.col("n") + F.col("after"),
            }
        ),
        "trie-conversations",
    )
    root = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), "length",
    )
    start = convs.select("conv", "length", F.explode("heads").alias("t")).select(
        "conv", F.col("t.at").alias("depth"), F.col("t.name").alias("node"), F.col("t.before").alias("parent"),
        F.col("t.chars").alias("chars"), "length",
    )
    # Both sides are tables, so that Spark can split the turns of one long conversation.
    rest = turns.join(convs.drop("heads").hint("merge"), "conv").where(F.col("at") > F.col("shared"))
    place = F.col("at") - F.col("shared")
    same = rest.where(F.col("front") == F.col("behind")).select(
        "conv", (F.col("n") + place).alias("depth"), F.col("name").alias("node"), F.col("before").alias("parent"), "chars", "length"
    )
    other = rest.where(F.col("front") != F.col("behind")).select(
        "conv", F.struct((F.col("n") + place).alias("depth"), "length").alias("at"), "name", "before", "chars", "front",
        "behind", place.alias("steps"),
    )
    schema = NAMED.replace("at long", "at struct<depth:bigint,length:bigint>")
    other = other.mapInArrow(_in_front, schema).select(
        "conv", "at.depth", F.col("name").alias("node"), F.col("before").alias("parent"), "chars", "at.length"
    )
    return root.unionByName(start).unionByName(same).unionByName(other)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """``(node, parent, conv, depth, members, children, weight, leaf, saved)``."""
    nodes = paths.groupBy("node").agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("members"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("chars").alias("chars"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    nodes = written(nodes, "trie-prefixes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("children")
    )
    return nodes.join(children.hint("merge"), "node", "left").select(
        "node", "parent", "conv", "depth", "members", F.coalesce("children", F.lit(0)).cast("long").alias("children"),
        "weight", F.col("children").isNull().cast("long").alias("leaf"),
        ((F.col("members") - 1) * F.col("chars")).alias("saved"),
    )


VALUES = ("leaf", "saved")


def rolled_component(parents: list[int], weights: list[int], values: list[list[int]], sums: list[list[int]]) -> None:
    """Adds to ``sums`` of each node what its subtree has of each of ``values``, by recursive centroids.

    The first node is the top, and its parent is not looked at. ``weights`` are those of whole subtrees.
    """
    children: list[list[int]] = [[] for _ in parents]
    for node in range(1, len(parents)):
        children[parents[node]].append(node)
    left, cut, tops = list(weights), [False] * len(parents), [0]
    while tops:
        top = tops.pop()
        path = [top]
        while (heavy := next((u for u in children[path[-1]] if not cut[u] and 2 * left[u] > left[top]), None)) is not None:
            path.append(heavy)
        centroid = path.pop()
        under = [centroid]
        for node in under:
            under += [u for u in children[node] if not cut[u]]
        for value, total in zip(values, sums):
            found = sum(value[u] for u in under)
            for node in (*path, centroid):
                total[node] += found
        for node in path:
            left[node] -= left[centroid]
        tops += [u for u in children[centroid] if not cut[u]]
        cut[centroid] = True
        if path:
            tops.append(top)


def _finish(frames):
    """Rows of whole components one after another, each from its top down."""

    def done(rows):
        at = {row[1]: i for i, row in enumerate(rows)}
        sums = [[row[4 + len(VALUES) + i] for row in rows] for i in range(len(VALUES))]
        values = [[row[4 + i] for row in rows] for i in range(len(VALUES))]
        rolled_component([at.get(row[2], -1) for row in rows], [row[3] for row in rows], values, sums)
        return _arrays([list(at), *sums], [pa.binary(), *[pa.int64()] * len(VALUES)], ["node", *VALUES])

    rows, top = [], None
    for _, *columns in batches(frames, "top", "node", "parent", "load", *VALUES, *(f"sum_{v}" for v in VALUES)):
        for row in zip(*columns):
            if row[0] != top and rows:
                yield done(rows)
                rows = []
            top = row[0]
            rows.append(row)
    if rows:
        yield done(rows)


def rolled_up(nodes: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(node, leaf, saved)``, summed over each node's subtree.

    ``load`` is the weight of a node's subtree inside its component, and ``top`` names the component.
    """
    state = nodes.select(
        "node", "parent", "conv", "depth", F.col("weight").alias("load"), *VALUES, F.lit(ROOT).alias("top"),
        *[F.lit(0).cast("long").alias(f"sum_{v}") for v in VALUES],
    )
    names, finished, ready = state.columns, [], []
    steps = paths.select(
        F.col("conv"), (F.col("depth") - 1).alias("above"), F.col("node").alias("step"), F.col("parent").alias("from")
    )
    while True:
        totals = state.groupBy("top").agg(F.max("load").alias("total"))
        large = written(totals.where(F.col("total") > limit), "trie-large")
        if large.limit(1).count() == 0:
            ready.append(state)
            break
        ready.append(state.join(large.select("top"), "top", "left_anti").select(names))
        inside = state.join(large, "top")
        heavy = inside.where(2 * F.col("load") > F.col("total"))
        centroids = heavy.groupBy("top").agg(F.max(F.struct("depth", "node", "load", "total")).alias("c"))
        centroids = written(centroids, "trie-centroids")
        marked = state.join(centroids, "top").withColumn("heavy", 2 * F.col("load") > F.col("c.total"))
        deeper = marked.where(F.col("depth") > F.col("c.depth")).withColumn("above", F.col("c.depth"))
        deeper = deeper.join(steps.hint("merge"), ["conv", "above"]).select(
            *names, "c", "heavy", F.when(F.col("from") == F.col("c.node"), F.col("step")).alias("child")
        )
        rest = marked.where(F.col("depth") <= F.col("c.depth")).select(
            *names, "c", "heavy", F.lit(None).cast("binary").alias("child")
        )
        moved = written(deeper.unionByName(rest), "trie-moved")
        is_centroid = F.col("node") == F.col("c.node")
        under = moved.where(F.col("child").isNotNull() | is_centroid).groupBy("top").agg(
            *[F.sum(v).alias(f"under_{v}") for v in VALUES]
        )
        under = written(under, "trie-under")
        new = {
            f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("heavy"), F.col(f"under_{v}")).otherwise(0) for v in VALUES
        }
        new["load"] = F.col("load") - F.when(F.col("heavy") & ~is_centroid, F.col("c.load")).otherwise(0)
        new["centroid"], new["top"] = is_centroid, F.coalesce("child", "top")
        level = written(moved.join(under, "top").withColumns(new).select(*names, "centroid"), "trie-level")
        finished.append(level.where("centroid"))
        state = level.where("not centroid").select(names)
    small = ready[0]
    for more in ready[1:]:
        small = small.unionByName(more)
    small = small.repartition("top").sortWithinPartitions("top", "depth")
    out = small.mapInArrow(_finish, "node binary, " + ", ".join(f"{v} long" for v in VALUES))
    for more in finished:
        out = out.unionByName(more.select("node", *[F.col(f"sum_{v}").alias(v) for v in VALUES]))
    return out


def _ids_sha256(frames):
    """A row for each node: the hash of its ids, which come one after another. A hash goes from start to
    end, so one node's ids pass through one task, but only a batch of them is held."""
    node, digest = None, None
    for batch, nodes, convs in batches(frames, "node", "conv"):
        out = []
        for n, c in zip(nodes, convs):
            if n != node:
                if digest:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(str(c).encode())
            else:
                digest.update(f",{c}".encode())
        yield _arrays(list(zip(*out)) or [(), ()], [pa.binary(), pa.string()], ["node", "ids"])
    if digest:
        yield _arrays([[node], [digest.hexdigest()]], [pa.binary(), pa.string()], ["node", "ids"])


def ends_sha256(paths: DataFrame) -> DataFrame:
    ends = paths.where("depth = length").select("node", "conv")
    ordered = ends.repartition("node").sortWithinPartitions("node", "conv")
    return ordered.mapInArrow(_ids_sha256, "node binary, ids string")


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie: smallest member, depth, its parent's smallest member, members,
    children, leaves and saved code points of its subtree, and the hash of the members that end there.

    Turns are in order of ``turn`` (null first), then role, then text; turns repeated in all of these are
    several turns. A null role or text is empty, an empty text is a turn like any other, and a text of
    any length is taken whole. Rows with a null ``conv_id`` belong to no conversation and are left out. An
    empty table has no node, not even a root. Extra columns are ignored, whatever their names. Equality of
    prefixes is taken from 127-bit hashes.
    """
    paths = written(rebuilt_paths(conversations), "trie-paths")
    nodes = written(trie_nodes(paths), "trie-nodes")
    rolled = written(rolled_up(nodes, paths, limit), "trie-rolled")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = nodes.drop(*VALUES).join(rolled.hint("merge"), "node").join(ends_sha256(paths).hint("merge"), "node", "left")
    # Written, so that Spark can split the children of one node.
    found = written(found, "trie-found").join(above.hint("merge"), "parent", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ids", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def sql() -> str:
    """The same in DuckDB's SQL, with sums over all pairs of a node and one above it."""
    # The usual reflected polynomial, bit by bit: a byte is followed by eight steps.
    crc = f"""xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
        string_split(conv_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) % {HEADS}"""
    return f"""
      WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
          PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS q
        FROM conversations WHERE conv_id IS NOT NULL
      ),
      convs AS (
        SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, len, {crc} AS h
        FROM (SELECT conv_id, count(*) AS len FROM turns GROUP BY conv_id)
      ),
      rebuilt AS (
        SELECT c.conv_id, t.q AS d, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.first AND t.q <= c.h
        UNION ALL
        SELECT c.conv_id, t.q - c.h + least(c.h, coalesce(f.len, 0)), t.role, t.text
        FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.q > c.h LEFT JOIN convs f ON f.conv_id = c.first
      ),
      paths AS (
        SELECT conv_id, 0 AS d, 0 AS chars, 'root' AS node FROM convs
        UNION ALL
        SELECT conv_id, d, length(text), sha256(string_agg(sha256(role) || sha256(text), '')
          OVER (PARTITION BY conv_id ORDER BY d)) FROM rebuilt
      ),
      ends AS (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id),
      ids AS (
        SELECT p.node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ids
        FROM paths p JOIN ends e USING (conv_id, d) GROUP BY p.node
      ),
      nodes AS (
        SELECT node, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs,
          (count(*) - 1) * any_value(chars) AS saved FROM paths GROUP BY node
      ),
      linked AS (
        SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.depth - 1
      ),
      children AS (SELECT parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
      rolled AS (
        SELECT p.node, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
        FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.depth LEFT JOIN children k ON k.node = n.node
        GROUP BY p.node
      )
      SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs,
        coalesce(k.n_children, 0) AS n_children, r.n_leaves, r.saved_tokens::BIGINT AS saved_tokens,
        coalesce(i.ids, sha256('')) AS ends_sha256
      FROM linked n JOIN rolled r USING (node) LEFT JOIN children k USING (node) LEFT JOIN ids i USING (node)
      LEFT JOIN nodes u ON u.node = n.parent"""
