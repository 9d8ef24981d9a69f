"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are the roles. A line (or a turn, where turns are given) is observed through its speaker marker (``User:``,
``### Assistant``, ...), its length, whether it asks, and how many text lines it has; its role is never an
observation. Transition and emission probabilities are counted over all labelled lines, outside a held-out fold if
one is named; Viterbi then finds the likeliest roles, with or without markers. Roles that a caller knows and doesn't
hide are kept, and the others are found around them.

Conversations can be of any length, so decoding is not per conversation. Lines are sorted once over the whole table
into ranges of bounded size. Viterbi steps are max-plus products, so a range is summed up by one small matrix for the
conversation that enters it and one for the one that leaves it. Those matrices are chained by conversation as a
tree, at most :data:`FAN` to a task, and every range then decodes its own lines between known ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, materialize, read

ROLES = ("system", "user", "assistant")
#: Speaker markers by role, as they stand at the start of a line.
MARKERS = {"system": "system|instructions?", "user": "user|human|customer|question|prompter|q", "assistant": "assistant|ai|bot|model|gpt|agent|answer|a"}
_HEAD = r"^\s*(?:<\|(?:im_start\|>)?|#{1,4}\s*|\[|\*{1,2})?"
_TAIL = r"(?:\|>|\]|\*{1,2})?\s*(?::|>|\n|$)\s*"
#: Classes of a line's observation: marker (0 none, then the roles), length in half octaves, question, text lines.
N_MARKERS, N_LENGTHS, N_ASKS, N_LINES = len(ROLES) + 1, 32, 2, 4
N_OBS = N_MARKERS * N_LENGTHS * N_ASKS * N_LINES
#: Lines per range, and matrices chained in one task.
RANGE_LINES, FAN = 50_000, 1024
#: Added to every count.
PRIOR = 0.5


def marker_pattern(role: str) -> str:
    return f"(?i){_HEAD}(?:{MARKERS[role]}){_TAIL}"


def role_number(role: Column) -> Column:
    """1 and the role's place in :data:`ROLES`; 0 if it is unknown."""
    out = F.lit(0)
    for i, r in enumerate(ROLES):
        out = F.when(F.lower(F.trim(role)) == r, i + 1).otherwise(out)
    return out


def marker_of(text: Column) -> Column:
    """0 without a marker, else 1 and the role's place in :data:`ROLES`."""
    out = F.lit(0)
    for i, r in reversed(list(enumerate(ROLES))):
        out = F.when(text.rlike(marker_pattern(r)), i + 1).otherwise(out)
    return out


def observe(text: Column, marker: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    size = F.least(F.floor(F.log2(F.length(t) + 1) * 2), F.lit(N_LENGTHS - 1)).cast("int")
    asks = F.when(F.rtrim(t).rlike(r"[?？]$"), 1).otherwise(0)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    lines = F.when(breaks == 0, 0).when(breaks == 1, 1).when(breaks < 4, 2).otherwise(3)
    return ((marker * N_LENGTHS + size) * N_ASKS + asks) * N_LINES + lines


class RoleModel:
    """Log probabilities: first role, transitions, and per role each observation."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        """``emit`` is role x observation; further observations, a role's number above, stand for a role that is known."""
        self.first, self.moves = first, moves
        known = [emit + np.where(np.arange(len(ROLES)) == k, 0.0, -1e9)[:, None] for k in range(len(ROLES))]
        self.emit = np.concatenate([emit, *known], axis=1)

    @classmethod
    def fit(cls, first: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> "RoleModel":
        """``counts``: role x marker x length x asks x lines. Features are independent given the role."""
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        flat = 0.0
        for axis in range(1, counts.ndim):
            others = tuple(i for i in range(1, counts.ndim) if i != axis)
            shape = [1] * counts.ndim
            shape[0], shape[axis] = counts.shape[0], counts.shape[axis]
            part = counts.sum(axis=others) + PRIOR
            if axis == 1:  # transcripts name the wrong speaker, or none, now and then
                part = part + 0.02 * counts.sum(axis=tuple(range(1, counts.ndim)))[:, None]
            flat = flat + log(part).reshape(shape)
        return cls(log(first + PRIOR), log(moves + PRIOR), flat.reshape(counts.shape[0], -1))

    def viterbi(self, obs: np.ndarray, enter: np.ndarray | None = None, leave: int | None = None) -> np.ndarray:
        """Roles of consecutive lines. ``enter``: scores of the roles of the line before; ``leave``: the last line's role."""
        emit, moves, n = self.emit[:, obs].T, self.moves, len(obs)
        back = np.zeros((n, len(ROLES)), np.int8)
        score = self.first + emit[0] if enter is None else None
        for t in range(n):
            if score is None or t:
                step = (enter if t == 0 else score)[:, None] + moves
                back[t] = step.argmax(axis=0)
                score = step.max(axis=0) + emit[t]
        out = np.zeros(n, np.int64)
        out[-1] = score.argmax() if leave is None else leave
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def matrix(self, obs: np.ndarray) -> np.ndarray:
        """Max-plus product of the lines: best score by the role before the first line (last row: no line before) and the role at the last."""
        total = np.vstack([self.moves, self.first]) + self.emit[:, obs[0]]
        for o in obs[1:]:
            total = (total[:, :, None] + self.moves[None]).max(axis=1) + self.emit[:, o]
        return total


def train(lines: DataFrame) -> RoleModel:
    """Counts over all lines (conv, turn, role 1-3 or 0, obs). Lines of one place count once in the transitions."""
    k = len(ROLES)
    counts = np.zeros((k, N_OBS))
    for r in lines.filter("role > 0").groupBy("role", "obs").count().collect():  # at most roles x observations rows
        counts[r["role"] - 1, r["obs"]] = r["count"]
    places = lines.filter("role > 0").groupBy("conv", "turn").agg(F.min("role").alias("role"))
    after = places.filter(F.col("turn") > _NULL).select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("then"))
    moves, first = np.zeros((k, k)), np.zeros(k)
    for r in places.join(after, ["conv", "turn"]).groupBy("role", "then").count().collect():
        moves[r["role"] - 1, r["then"] - 1] = r["count"]
    starts = places.groupBy("conv").agg(F.min_by("role", "turn").alias("role"))
    for r in starts.groupBy("role").count().collect():
        first[r["role"] - 1] = r["count"]
    return RoleModel.fit(first, moves, counts.reshape(k, N_MARKERS, N_LENGTHS, N_ASKS, N_LINES))


def _groups(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, slice]]]:
    """The range in order, and each conversation's rows in it."""
    pdf = pdf.sort_values(["conv", "turn", "tie", "obs"], ignore_index=True)
    key = pdf["conv"].to_numpy()
    bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return pdf, [(int(key[s]), slice(s, e)) for s, e in zip(bounds, bounds[1:])]


def _summaries(shared):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, groups = _groups(pdf)
        obs, k = pdf["obs"].to_numpy(), len(groups)
        ends = sorted({0, k - 1})
        return pd.DataFrame([(int(pdf["part"][0]), i, groups[i][0], shared.value.matrix(obs[groups[i][1]]).ravel().tolist()) for i in ends], columns=["part", "at", "conv", "matrix"])

    return run


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of consecutive matrices (see :meth:`RoleModel.matrix`)."""
    total = matrices[0]
    for m in matrices[1:]:
        total = (total[:, :, None] + m[None, :-1]).max(axis=1)
    return total


def between(matrices: list[np.ndarray], enter: np.ndarray | None, leave: int | None) -> list[tuple[np.ndarray | None, int]]:
    """For each of consecutive matrices: scores on entering it and the role on leaving it, given both for the whole."""
    into, scores = [], enter
    for m in matrices:
        into.append(scores)
        scores = m[-1] if scores is None else (scores[:, None] + m[:-1]).max(axis=0)
    role = int(scores.argmax()) if leave is None else leave
    roles = [role]
    for m, before in zip(matrices[:0:-1], into[:0:-1]):
        role = int((before + m[:-1, role]).argmax())
        roles.append(role)
    return list(zip(into, roles[::-1]))


_LINK = "conv long, seq long, matrix array<double>"
_ENDS = "conv long, seq long, enter array<double>, leave int"


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(m).reshape(-1, len(ROLES)) for m in pdf["matrix"]]


def _multiply(fan: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame([(int(pdf["conv"].iloc[0]), int(pdf["seq"].iloc[0]) // fan, product(_matrices(pdf)).ravel().tolist())], columns=["conv", "seq", "matrix"])

    return run


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    outer = "leave" in pdf.columns
    enter = pdf["enter"].iloc[0] if outer else None
    ends = between(_matrices(pdf), None if enter is None else np.array(enter), int(pdf["leave"].iloc[0]) if outer else None)
    return pd.DataFrame([(int(c), int(q), None if e is None else e.tolist(), leave) for c, q, (e, leave) in zip(pdf["conv"], pdf["seq"], ends)], columns=["conv", "seq", "enter", "leave"])


def chain(links: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv, seq, matrix) -> enter and leave of each, at most ``fan`` matrices in a task."""
    longest = links.agg(F.max("seq")).first()[0]
    if longest is None or longest < fan:
        return links.groupBy("conv").applyInPandas(_solve, _ENDS)
    block = F.floor(F.col("seq") / fan).cast("long")
    upper = materialize(links.groupBy("conv", block.alias("block")).applyInPandas(_multiply(fan), _LINK), "links")
    outer = chain(upper, fan).withColumnRenamed("seq", "block")
    return links.withColumn("block", block).join(outer, ["conv", "block"]).groupBy("conv", "block").applyInPandas(_solve, _ENDS)


def _decode(shared):
    def run(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        known = {int(c): (None if e is None else np.array(e), int(leave)) for c, e, leave in zip(ends["conv"], ends["enter"], ends["leave"])}
        if not len(pdf):
            return pd.DataFrame({"conv": [], "turn": [], "tie": [], "found": []})
        pdf, groups = _groups(pdf)
        obs, found = pdf["obs"].to_numpy(), np.zeros(len(pdf), np.int64)
        for key, at in groups:
            found[at] = model.viterbi(obs[at], *known.get(key, (None, None)))
        pdf["found"] = found
        return pdf[["conv", "turn", "tie", "found"]]

    return run


_NULL = -(2**63)


def decode(lines: DataFrame, model: RoleModel, range_lines: int = RANGE_LINES, fan: int = FAN) -> DataFrame:
    """Roles (found, a place in :data:`ROLES`) of distinct lines (conv, turn, tie, obs)."""
    shared = lines.sparkSession.sparkContext.broadcast(model)  # fixed by roles and observations
    n = max(1, -(-lines.count() // range_lines))
    ranged = lines.repartitionByRange(n, "conv", "turn", "tie").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")  # the ranges stay as they were dealt
    grouped = ranged.groupBy("part")
    ends = grouped.applyInPandas(_summaries(shared), "part int, at int, conv long, matrix array<double>")
    ends = materialize(ends, "ends")  # two rows per range at most
    spans = ends.groupBy("conv").agg(F.count("*").alias("n"), F.min("part").alias("from")).filter("n > 1")
    # a conversation that spans ranges has one row in each of them, and nothing stands between
    links = ends.join(spans, "conv").select("conv", (F.col("part") - F.col("from")).cast("long").alias("seq"), "part", "matrix")
    links = materialize(links, "links")
    solved = chain(links.select("conv", "seq", "matrix"), fan).join(links.select("conv", "seq", "part"), ["conv", "seq"])
    solved = materialize(solved.select("part", "conv", "enter", "leave"), "solved")
    return grouped.cogroup(solved.groupBy("part")).applyInPandas(_decode(shared), "conv long, turn long, tie long, found int")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", hide_roles: bool = False, holdout: tuple[int, int] | None = None) -> DataFrame:
    """One row per input row: conv_id, turn, given_role, marker_role (what the marker says, or null), role, rendered.

    Roles in ``role_col`` train the model and are kept; where they are missing, Viterbi finds them. With
    ``hide_roles`` they train and are otherwise not seen: every role is found. ``holdout`` (n, k) keeps conversations
    whose crc32(id as text) mod n is k out of training. Without any role, markers train.

    Rendering is ``<|im_start|>role``, the text, ``<|im_end|>``; a conversation is its rows' renderings in the order of
    turns. A marker is left out only where it is in the text, agrees with a role that was found, and text follows it.
    Rows with a null conversation or turn come first in theirs; null texts are empty; rows of one turn are ordered by a
    hash of the text; equal scores go to the first of :data:`ROLES`; repeated rows are decoded once and share their
    role; an unknown role counts as none; an empty table gives no rows; extra columns are ignored.
    """
    text = F.col(text_col)
    marker = marker_of(F.coalesce(text, F.lit("")))
    given = role_number(F.col(role_col)) if role_col else F.lit(0)
    label = given if role_col else marker
    known = F.lit(0) if hide_roles else given
    obs = observe(text, marker)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn_id"), text.alias("text"),
        F.coalesce(F.col(conv_col).cast("long"), F.lit(_NULL)).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(_NULL)).alias("turn"),
        marker.alias("marker"), label.alias("label"), given.alias("given"), known.alias("known"),
        F.xxhash64(text, known).alias("tie"), (obs + N_OBS * known).alias("obs"), obs.alias("plain"),
    )
    fit = rows if holdout is None else rows.filter(crc_of_id("conv_id") % holdout[0] != holdout[1])
    model = train(fit.select("conv", "turn", F.col("label").alias("role"), F.col("plain").alias("obs")))
    found = decode(rows.select("conv", "turn", "tie", "obs").distinct(), model)
    name = lambda n: F.element_at(F.array(*map(F.lit, ROLES)), n)
    role = name(F.col("found") + 1)
    plain = F.coalesce(F.col("text"), F.lit(""))
    body = plain
    for i, r in enumerate(ROLES):
        rest = F.regexp_replace(plain, marker_pattern(r), "")
        body = F.when((F.col("known") == 0) & (F.col("marker") == i + 1) & (F.col("found") == i) & (F.trim(rest) != ""), rest).otherwise(body)
    said = lambda c: F.when(F.col(c) > 0, name(F.greatest(c, F.lit(1))))
    return rows.join(found.groupBy("conv", "turn", "tie").agg(F.min("found").alias("found")), ["conv", "turn", "tie"]).select(
        "conv_id", F.col("turn_id").alias("turn"), said("given").alias("given_role"), said("marker").alias("marker_role"), role.alias("role"),
        F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), body, F.lit("<|im_end|>\n")).alias("rendered"),
    )


def transcript_lines(transcripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole transcripts as rows of lines (conv_id, turn, text), for :func:`format_turns` with ``role_col=None``."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"))
    return transcripts.select(F.col(id_col).alias("conv_id"), lines.alias("turn", "text"))


#: Conversations whose crc32(id as text) mod the first number is the second are held out of training.
HOLDOUT = (4, 2)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's role from its text and its neighbours alone; the given role only trains, outside the fold, and is shown for the score."""
    out = format_turns(read(spark, sf_dir, "conversations"), hide_roles=True, holdout=HOLDOUT)
    return out.withColumn("held_out", crc_of_id("conv_id") % HOLDOUT[0] == HOLDOUT[1])
