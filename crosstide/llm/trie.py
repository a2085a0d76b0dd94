"""Prefix trie of conversations: nodes by prefix fingerprints, subtree totals by parallel tree contraction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.llm.common import sha256
from crosstide.operators.ranking import running_total
from crosstide.session import reliable_checkpoint

#: Turns of a conversation, and ids of a list, that one step holds together.
BLOCK = 1024
ID_BLOCK = 4096
#: Fixed values of the contract: conversations in a family, and the most turns they share plus one.
FAMILY, SHARED = 5, 9


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with their place in the conversation: conv, pos (from 1), t1, t2 (128-bit hash of role and text), n_bytes.

    Turns follow each other by number, those without one first; of equal numbers the hash
    decides, and repeated rows are turns of their own. Null role and text count as empty. Rows without a
    conversation are left out. Places are running counts over ranges of rows, so a
    conversation may hold most of the table; texts are hashed where they are read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    same = rows.groupBy("conv", "turn", "t1", "t2").agg(F.count(F.lit(1)).alias("m"), F.min("n_bytes").alias("n_bytes"))
    counted = running_total(same, ["conv"], ["turn", "t1", "t2"], weight=F.col("m"), out="upto")
    return counted.select("conv", F.explode(F.sequence(F.col("upto") - F.col("m") + 1, F.col("upto"))).alias("pos"), "t1", "t2", "n_bytes")


def as_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, for :func:`prefix_nodes`: rows (conv, d, t1, t2, n_bytes, last) and convs (conv, len)."""
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    return turns.join(lengths, "conv").select("conv", F.col("pos").alias("d"), "t1", "t2", "n_bytes", (F.col("pos") == F.col("len")).alias("last")), lengths


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first of their family, as rows and convs like :func:`as_sequences`.

    Conversation c becomes the first h turns of conversation c - c % family, as far as there
    are any, and its own turns after its first h; h is the crc32 of c in decimal, modulo ``shared``.
    A head goes to the members of its family only.
    """
    h = F.crc32(F.col("conv").cast("string")) % shared
    first = F.col("conv") - F.col("conv") % family
    heads = turns.filter((F.col("conv") == first) & (F.col("pos") < shared)).withColumnRenamed("conv", "base")
    have = heads.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumns({"h": h, "base": first}).join(have, "base", "left")
    taken = F.least("h", F.coalesce("have", F.lit(0)))
    convs = convs.select("conv", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = reliable_checkpoint(convs)
    end = lambda d: (d == F.col("len")).alias("last")
    opening = convs.join(heads, "base").filter("pos <= h").select("conv", F.col("pos").alias("d"), "t1", "t2", "n_bytes", end(F.col("pos")))
    place = F.col("pos") - F.col("h") + F.col("k")
    own = turns.join(convs, "conv").filter("pos > h").select("conv", place.alias("d"), "t1", "t2", "n_bytes", end(place))
    return opening.unionByName(own), convs.select("conv", "len")


def prefix_nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and which conversations end where.

    A prefix is known by the exclusive-or of its turns' hashes, each salted with its place: 128
    bits, summed per block of turns and then within the block, so no task orders more of a
    conversation than a block of turns or one number per block. Nodes: d, p1, p2 (the prefix), conv (its
    smallest member), n (members), n_bytes (of its last text), parent (the parent's conv; null at the
    root). Ends: d, p1, p2, conv.
    """
    salted = rows.select("conv", "d", F.xxhash64(F.lit(1), "d", "t1", "t2").alias("x1"), F.xxhash64(F.lit(2), "d", "t2", "t1").alias("x2"), "n_bytes", "last", F.floor(F.col("d") / BLOCK).alias("block"))
    salted = reliable_checkpoint(salted)
    blocks = salted.groupBy("conv", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(ahead), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    here = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = salted.withColumns({f"p{i}": F.bit_xor(f"x{i}").over(here) for i in (1, 2)}).join(before, ["conv", "block"])
    prefix = [F.col(f"p{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    seen = whole.select("conv", "d", prefix[0].alias("p1"), prefix[1].alias("p2"), "x1", "x2", "n_bytes", "last")
    seen = reliable_checkpoint(seen)
    nodes = seen.groupBy("d", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("n_bytes").alias("n_bytes"), F.min("x1").alias("x1"), F.min("x2").alias("x2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    root = root.select(*[zero.alias(c) for c in ("d", "p1", "p2")], "conv", "n", *[zero.alias(c) for c in ("n_bytes", "x1", "x2")])
    nodes = reliable_checkpoint(nodes.unionByName(root))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    up = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)]
    nodes = nodes.select("d", "p1", "p2", "conv", "n", "n_bytes", *up).join(above, ["d", "q1", "q2"], "left").drop("q1", "q2")
    ends = seen.filter("last").select("d", "p1", "p2", "conv").unionByName(convs.filter("len = 0").select(*[zero.alias(c) for c in ("d", "p1", "p2")], "conv"))
    return nodes, ends


def id_list_hashes(ends: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """SHA-256 of the ids of each group in ascending order, in decimal and joined by commas: keys, ids_sha256.

    The ids of a group, each once, are joined per stretch of ``ID_BLOCK`` numbers. A group of several
    stretches is hashed by reading these strings in order, one at a time; a digest has no
    parallel form, but its task gets a string per stretch instead of a row per id.
    """
    keys = list(keys)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(id_col)), lambda i: i.cast("string")), ",")
    parts = ends.groupBy(*keys, F.floor(F.col(id_col) / ID_BLOCK).alias("stretch")).agg(joined.alias("ids"))
    parts = reliable_checkpoint(parts)
    many = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("stretches"))
    parts = parts.join(many, keys)
    single = parts.filter("stretches = 1").select(*keys, sha256(F.col("ids")).alias("ids_sha256"))
    ordered = parts.filter("stretches > 1").select(*keys, "stretch", "ids").repartition(*keys).sortWithinPartitions(*keys, "stretch")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, state = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, key in enumerate(zip(*columns)):
                ids = batch.column("ids")[i].as_py()
                if key != at:
                    if at is not None:
                        yield _row(at, state.hexdigest())
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if at is not None:
            yield _row(at, state.hexdigest())

    schema = single.schema
    kinds = [pa.int64()] * len(keys)

    def _row(key: tuple, found: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(key, kinds)], pa.array([found])], [*keys, "ids_sha256"])

    return single.unionByName(ordered.mapInArrow(digest, schema))


def _compress(active: DataFrame, values: Sequence[str], width: int) -> DataFrame:
    """Takes the nodes with one child out of each stretch of ``width`` depths of a line, if that child lies in it, too.

    What stays at the end of such a run hangs on the node above it and carries what lay between. Rows
    taken out name it as ``heir`` and hold in ``more_<value>`` what they have besides its total.
    """
    stretch = ["line", F.floor(F.col("depth") / width)]
    along = Window.partitionBy(*stretch).orderBy("depth")
    active = active.withColumn("stretch", stretch[1])
    single = (F.col("kids") == 1) & F.col("parent").isNotNull()
    active = active.withColumn("out", F.coalesce(single & (F.lead("parent").over(along) == F.col("id")), F.lit(False)))
    stayed = F.count_if(~F.col("out")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    run = Window.partitionBy("line", "stretch", "run").orderBy("depth")
    whole, upto = (run.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, Window.currentRow))
    active = active.withColumn("run", stayed)
    columns = {"heir": F.when(F.col("out"), F.last("id").over(whole)), "top": F.first("parent").over(whole)}
    for v in values:
        own, carry = F.when(F.col("out"), F.col(v)).otherwise(0), F.col(f"carry_{v}")
        between = F.sum(own + carry).over(whole)
        columns[f"sum_{v}"] = between
        columns[f"more_{v}"] = between - F.sum(own + carry).over(upto) + own
    done = active.withColumns(columns)
    return done.select(
        "id", F.when(F.col("out"), F.col("parent")).otherwise(F.col("top")).alias("parent"), "line", "depth", "kids", "out", "heir", *values,
        *[F.when(F.col("out"), F.col(f"carry_{v}")).otherwise(F.col(f"sum_{v}")).alias(f"carry_{v}") for v in values], *[f"more_{v}" for v in values],
    )


def _splice(active: DataFrame, values: Sequence[str], salt: int) -> DataFrame:
    """Takes nodes out of chains of nodes with one child, wherever they lie: one in three, those that a hash with
    ``salt`` puts above their parent whose own parent it does not put below.

    The child hangs on the node above and carries what lay between. Its row names the node taken out as
    ``via`` and holds in ``via_<value>`` what that node has besides the child's total.
    """
    zero = F.lit(0).cast("long")
    marked = (F.col("kids") == 1) & F.col("parent").isNotNull() & (F.xxhash64(F.lit(salt), "id") > F.xxhash64(F.lit(salt), "parent"))
    active = reliable_checkpoint(active.withColumn("marked", F.coalesce(marked, F.lit(False))))
    under = active.filter("marked").select(F.col("id").alias("mark"))
    active = active.join(under, F.col("parent") == F.col("mark"), "left").withColumn("out", F.col("marked") & F.col("mark").isNull()).drop("mark", "marked")
    out = active.filter("out").select(
        F.col("id").alias("via"), F.col("parent").alias("to"), *[F.col(v).alias(f"own_{v}") for v in values], *[F.col(f"carry_{v}").alias(f"more_{v}") for v in values]
    )
    done = active.filter("not out").join(out, F.col("parent") == F.col("via"), "left").select(
        "id", F.coalesce("to", "parent").alias("parent"), "line", "depth", "kids", *values, "via",
        *[(F.col(f"carry_{v}") + F.coalesce(F.col(f"own_{v}") + F.col(f"more_{v}"), zero)).alias(f"carry_{v}") for v in values],
        *[(F.col(f"carry_{v}") + F.coalesce(f"own_{v}", zero)).alias(f"via_{v}") for v in values],
    )
    return reliable_checkpoint(done)


def subtree_totals(tree: DataFrame, values: Sequence[str], width: int = BLOCK) -> DataFrame:
    """Sum of each of ``values`` over the subtree of every node: id, then the totals under the names of the values.

    ``tree`` has id, parent (null at a root), line, depth (a parent's is less) and whole numbers as values. A
    line is any set of nodes of different depths that chains of only children follow as a rule, such as those of
    one smallest member. Rounds of parallel tree contraction: compress replaces chains of nodes
    with one child by their last node, which carries what lay between; rake adds the totals of all
    leaves to their parents and takes the leaves away. Compress first works on stretches of ``width`` depths of a
    line, ``width`` times longer in each further round, by a window; of chains that cross lines it then takes one
    node in three, by joins. So a round takes the outermost branches off the tree and shortens what chains are left by
    a share: rounds grow as the logarithm of the nodes, whatever the depth. Then the nodes taken out come back, the last
    ones first, from the total of the node that took their place. Leaves are summed before the shuffle; rounds move
    numbers only, and each is written to the checkpoint folder.

    Values must not be null. A parent that is not in the table makes a root; a circle is an error. An empty table
    returns no rows.
    """
    values = list(values)
    zero = F.lit(0).cast("long")
    children = tree.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("kids"))
    depth = F.col("depth").cast("long")
    active = tree.select("id", "parent", "line", depth.alias("depth"), *[F.col(v).cast("long").alias(v) for v in values])
    active = active.join(children, F.col("id") == F.col("of"), "left").drop("of").withColumn("kids", F.coalesce("kids", zero))
    active = active.withColumns({f"carry_{v}": zero for v in values})
    rounds: list[DataFrame] = []
    left, reach = True, width
    while left:
        packed = reliable_checkpoint(_compress(active, values, reach))
        rounds.append(packed.filter("out").select("id", "heir", *[f"more_{v}" for v in values]))
        rounds.append(packed.filter("not out and kids = 0").select("id", *values))
        chained = "not out and kids = 1 and parent is not null"
        gone, left, chained = packed.agg(*[F.count_if(F.expr(x)) for x in ("out or kids = 0", "not out and kids > 0", chained)]).first()
        if left and not gone:
            raise ValueError("the parents form a circle")
        reach = min(reach * width, 1 << 60)
        stay = packed.filter("not out")
        raked = stay.filter("kids = 0 and parent is not null").groupBy(F.col("parent").alias("of"))
        raked = raked.agg(F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(f"carry_{v}")).alias(f"add_{v}") for v in values])
        active = stay.filter("kids > 0").join(raked, F.col("id") == F.col("of"), "left").select(
            "id", "parent", "line", "depth", *[(F.col(v) + F.coalesce(f"add_{v}", zero)).alias(v) for v in values],
            (F.col("kids") - F.coalesce("gone", zero)).alias("kids"), *[f"carry_{v}" for v in values],
        )
        if chained:
            active = _splice(active, values, len(rounds))
            rounds.append(active.filter("via is not null").select(F.col("via").alias("id"), F.col("id").alias("heir"), *[F.col(f"via_{v}").alias(f"more_{v}") for v in values]))
    # in each round the leaves' totals are known before the nodes that compress took out ask for them
    tasks = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = tree.select("id", *values).limit(0)
    for k in reversed(range(len(rounds))):
        if "heir" not in rounds[k].columns:
            known = known.unionByName(rounds[k])
            continue
        totals = known.select(F.col("id").alias("last"), *[F.col(v).alias(f"of_{v}") for v in values])
        back = rounds[k].join(totals, F.col("heir") == F.col("last")).select("id", *[(F.col(f"more_{v}") + F.col(f"of_{v}")).alias(v) for v in values])
        known = reliable_checkpoint(known.unionByName(back).coalesce(tasks))
    return known


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of sequences of turns, one row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A node is named by its smallest member and its depth. ``n_leaves`` counts the childless nodes of its
    subtree, ``saved_tokens`` sums (members - 1) times the bytes of the last text over it, and ``ends_sha256``
    hashes the conversations that end there. Conversations without turns end at the root; without any
    conversation there is no node.
    """
    nodes, ends = prefix_nodes(rows, convs)
    name = lambda conv, d: F.when(conv.isNotNull(), F.struct(conv.alias("conv"), d.alias("d")))
    nodes = nodes.withColumns({"id": name(F.col("conv"), F.col("d")), "up": name(F.col("parent"), F.col("d") - 1)})
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("id") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = reliable_checkpoint(nodes)
    leaf = (F.col("n_children") == 0).cast("long")
    tree = nodes.select("id", F.col("up").alias("parent"), F.col("conv").alias("line"), F.col("d").alias("depth"), leaf.alias("n_leaves"), ((F.col("n") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).withColumnRenamed("id", "of")
    hashes = id_list_hashes(ends, ["d", "p1", "p2"], "conv")
    out = nodes.join(totals, F.col("id") == F.col("of")).join(hashes, ["d", "p1", "p2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ids_sha256", sha256(F.lit(""))).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all rebuilt conversations; see :func:`numbered_turns`, :func:`rebuilt` and :func:`prefix_trie` for the edge cases."""
    turns = reliable_checkpoint(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(*rebuilt(turns))
