"""Transcript parsing: a hidden Markov model recovers the roles of lines, turns are rendered canonically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.llm.common import is_held_out, sha256
from crosstide.session import reliable_checkpoint

ROLES = ["system", "user", "assistant"]
#: States: each role, at the first line of a turn (even) or further in (odd).
STATES = 2 * len(ROLES)
#: Words that open a turn when they stand alone before a colon, bracket or line end.
MARKERS = ["system", "context", "instructions", "user", "human", "question", "q", "customer", "assistant", "ai", "bot", "answer", "a", "agent", "response"]
MARKER = r"^[\s#*\[<|>]*(?i)(" + "|".join(MARKERS) + r")(?:\s*[\]*|>]*\s*:\s*|\s*[\]|>]+\s*|\s*$)"
#: Turns per block; a block is what one step of the decoder holds.
BLOCK = 64
#: Length classes of a line, and observations in all: marker x length class x question.
LENGTHS = (0, 20, 60, 120, 200, 300, 450)
OBSERVATIONS = (len(MARKERS) + 1) * (len(LENGTHS) + 1) * 2
ORDER = ["turn", "rh", "pos"]


def observe(line: Column) -> Column:
    """Code of a line's features: its speaker marker, length class, and whether it ends in a question mark."""
    word = F.lower(F.regexp_extract(line, MARKER, 1))
    marker = F.array_position(F.lit(MARKERS), word)  # 0: none
    size = sum((F.length(line) > n).cast("int") for n in LENGTHS)
    return ((marker * (len(LENGTHS) + 1) + size) * 2 + F.rtrim(line).endswith("?").cast("int")).cast("int")


def transcript_lines(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = None) -> DataFrame:
    """Lines of transcripts: conv, turn, rh (hash of the text), pos, line, block and, if given, state.

    Null text is one empty line. Rows that repeat a turn follow each other by their hash. Turns
    without a number come first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.col(role_col) if role_col else F.lit(None).cast("string")
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col), F.lit(-1)).cast("long").alias("turn"), F.xxhash64(text).alias("rh"), role.alias("role"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    at = F.array_position(F.lit(ROLES), F.col("role")) - 1
    state = F.when(at >= 0, at * 2 + (F.col("pos") > 0).cast("int")).cast("int")
    return rows.select("conv", *ORDER, "line", F.floor(F.col("turn") / BLOCK).alias("block"), state.alias("state"), observe(F.col("line")).alias("obs"))


class RoleModel:
    """Logarithms of start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def transfer(self, obs: np.ndarray) -> np.ndarray:
        """Best score of any path over a block that comes from state a (row; the last row: a start) and ends in state b."""
        score = np.vstack((self.move, self.start)) + self.emit[:, obs[0]]
        for o in obs[1:]:
            score = (score[:, :, None] + self.move[None]).max(axis=1) + self.emit[:, o]
        return score

    def viterbi(self, obs: np.ndarray, before: int, last: int) -> np.ndarray:
        """Best states of a block between the state before it (-1: a start) and its last state (-1: free)."""
        score = (self.start if before < 0 else self.move[before]) + self.emit[:, obs[0]]
        back = np.zeros((len(obs), STATES), np.int64)
        for t in range(1, len(obs)):
            path = score[:, None] + self.move
            back[t] = path.argmax(axis=0)
            score = path.max(axis=0) + self.emit[:, obs[t]]
        states = np.empty(len(obs), np.int64)
        states[-1] = int(score.argmax()) if last < 0 else last
        for t in range(len(obs) - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states


def fit_roles(lines: DataFrame, smoothing: float = 0.5) -> RoleModel:
    """Model from lines with known states, by smoothed counts; without any, all is equally likely.

    Emissions are counted over all lines, transitions over all neighbours within a block of turns,
    starts over all first lines. A few hundred counts reach the driver, whatever the input.
    """
    known = lines.filter("state is not null")
    w = Window.partitionBy("conv", "block").orderBy(*ORDER)
    pairs = known.select("state", F.lag("state").over(w).alias("prev"), "block")
    start, move = np.full(STATES, smoothing), np.full((STATES, STATES), smoothing)
    emit = np.full((STATES, OBSERVATIONS), smoothing / OBSERVATIONS)
    for r in known.groupBy("state", "obs").count().collect():
        emit[r["state"], r["obs"]] += r["count"]
    for r in pairs.groupBy("prev", "state").count().collect():
        if r["prev"] is not None:
            move[r["prev"], r["state"]] += r["count"]
    for r in known.filter("pos = 0 and turn <= 0").groupBy("state").count().collect():
        start[r["state"]] += r["count"]
    for role in range(len(ROLES)):  # a further line follows a line of its own turn, and no transcript starts with one
        start[2 * role + 1] = 0
        move[[s for s in range(STATES) if s // 2 != role], 2 * role + 1] = 0
    with np.errstate(divide="ignore"):
        return RoleModel(*[np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, move, emit)])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block after the other, from batches that are sorted by conv and block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        if held and (held[0].column("conv")[0].as_py(), held[0].column("block")[0].as_py()) != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cuts, cuts[1:]):
            held.append(batch.slice(i, j - i))
            if j < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def recover_roles(lines: DataFrame, model: RoleModel) -> DataFrame:
    """Most likely state of every line, by Viterbi over its whole conversation: conv, turn, rh, pos, block, found.

    Only observation codes move. A conversation is dealt into blocks of turns: a block first gives
    its best score from each state to each; a conversation then fixes the states at its block
    ends from these tables, and each block is decoded between them. So a task holds a
    block's lines, or one table of a few dozen numbers per block.
    """
    kind = lines.schema["conv"].dataType.simpleString()
    codes = reliable_checkpoint(lines.select("conv", *ORDER, "block", "obs"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            table = model.transfer(block.column("obs").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [block.column("conv").slice(0, 1).combine_chunks(), block.column("block").slice(0, 1).combine_chunks(), pa.array([table.ravel().tolist()])], ["conv", "block", "t"]
            )

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, blocks in enumerate(batch.column("blocks").to_pylist()):
                scores, backs = None, []
                for b in blocks:
                    t = np.array(b["t"]).reshape(STATES + 1, STATES)
                    path = t[-1:] if scores is None else scores[:, None] + t[:-1]
                    backs.append(path.argmax(axis=0))
                    scores = path.max(axis=0)
                last, states = int(scores.argmax()), []
                for back in reversed(backs):
                    states.append(last)
                    last = int(back[last])
                states.reverse()
                out += [(row, b["block"], s0, s1) for b, s0, s1 in zip(blocks, [-1, *states], states)]
            row, block, before, last = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("conv").take(pa.array(row)), *map(pa.array, (block, before, last))], ["conv", "block", "before", "last"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            states = model.viterbi(block.column("obs").to_numpy(), block.column("before")[0].as_py(), block.column("last")[0].as_py())
            yield from block.drop_columns(["obs", "before", "last"]).append_column("found", pa.array(states)).combine_chunks().to_batches()

    dealt = codes.repartition("conv", "block").sortWithinPartitions("conv", "block", *ORDER)
    scored = dealt.mapInArrow(tables, f"conv {kind}, block long, t array<double>")
    chains = scored.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "t"))).alias("blocks"))
    bounds = reliable_checkpoint(chains.mapInArrow(ends, f"conv {kind}, block long, before long, last long"))
    joined = codes.join(bounds, codes["conv"].eqNullSafe(bounds["conv"]) & (codes["block"] == bounds["block"])).select(codes["*"], "before", "last")
    joined = joined.repartition("conv", "block").sortWithinPartitions("conv", "block", *ORDER)
    return joined.mapInArrow(decode, f"conv {kind}, turn long, rh long, pos int, block long, found long")


def render_turns(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Turns as the states cut them, without their speaker markers: conv, turn_no (from 0), role, text, rendered, n_lines.

    A turn is rendered as ``<|role|>``, its text and ``<|end|>``, each on lines of their own.
    Turns are numbered by adding what the blocks before hold; a turn's lines are brought
    together, a conversation's are not.
    """
    marked = states.withColumn("opens", (F.col("found") % 2 == 0).cast("int"))
    per_block = marked.groupBy("conv", "block").agg(F.sum("opens").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("conv", "block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("nth", F.sum("opens").over(here))
    numbered = numbered.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    numbered = numbered.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("rh").alias("h"), F.col("pos").alias("p"), (F.col("nth") + F.col("ahead") - 1).alias("turn_no"), "found")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("rh") == F.col("h")) & (F.col("pos") == F.col("p"))
    said = F.when(F.col("found") % 2 == 0, F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    parts = lines.join(numbered, same).select("conv", "turn_no", F.floor(F.col("found") / 2).cast("int").alias("r"), F.struct(*ORDER, said.alias("said")).alias("part"))
    turns = parts.groupBy("conv", "turn_no").agg(F.min("r").alias("r"), F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.btrim(F.array_join(F.transform("parts", lambda p: p["said"]), "\n"), F.lit("\n"))
    role = F.get(F.lit(ROLES), F.col("r"))
    out = turns.select("conv", "turn_no", role.alias("role"), text.alias("text"), F.size("parts").cast("long").alias("n_lines"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")))


def as_transcript(turns: DataFrame) -> DataFrame:
    """Turns of ``conversations`` as they look in raw transcripts: the text led by a speaker marker in one of five styles
    per conversation, and in one turn of four by none."""
    names = [["System: ", "User: ", "Assistant: "], ["Instructions: ", "Human: ", "AI: "], ["Context: ", "Q: ", "A: "], ["### System\n", "### User\n", "### Response\n"], ["[system] ", "[customer] ", "[agent] "]]
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(names))).cast("int")
    marker = F.get(F.get(F.lit(names), style), (F.array_position(F.lit(ROLES), F.col("role")) - 1).cast("int"))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    return turns.withColumn("text", F.concat(F.when(bare, F.lit("")).otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit(""))))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the transcripts of all conversations; the model learns from those with crc32(conv_id) mod 4 <> 0."""
    turns = as_transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    held_out = is_held_out("conv_id", 4, 0)
    model = fit_roles(transcript_lines(turns.filter(~held_out), role_col="role"))
    lines = transcript_lines(turns)
    out = render_turns(lines, recover_roles(lines, model)).withColumnRenamed("conv", "conv_id")
    return out.select("conv_id", "turn_no", "role", "n_lines", sha256(F.col("text")).alias("text_sha256"), sha256(F.col("rendered")).alias("rendered_sha256")).withColumn("held_out", held_out)
