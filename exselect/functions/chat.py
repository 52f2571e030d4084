"""Chat rows: rendering, terms, assistant label masks and exact lookup."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Roles that are rendered, the masked label and the ASCII whitespace class.
ROLES = ("system", "user", "assistant")
MASKED = -100
WHITESPACE = "[ \\t\\n\\r\\f\\x0b]+"
# Rows that are Python objects at a time; an Arrow batch holds many more.
CHATS_PER_STEP, ROWS_PER_STEP = 32, 256
PLAIN_TYPES = {"string", "bigint", "int", "double", "float", "boolean"}


def row_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def terms_of(text: Column | str) -> Column:
    """Terms of a text: split on ASCII whitespace, no empty terms.

    Trimming first leaves nothing to filter out of the split.
    """
    inner = F.btrim(_column(text), F.lit(" \t\n\r\f\x0b"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITESPACE))


def tokenize(df: DataFrame, text_col: str = "text", max_len: int | None = 4096) -> DataFrame:
    """Add `terms`; `max_len=None` keeps whole texts."""
    terms = terms_of(text_col)
    return df.withColumn("terms", terms if max_len is None else F.slice(terms, 1, max_len))


def token_ids(terms: Column | str) -> Column:
    """Integer ids of terms."""
    return F.transform(terms, lambda term: F.xxhash64(term))


def as_messages(conversations: DataFrame, first: int | None = None) -> DataFrame:
    """Long turns (conv_id, turn, role, text) to one row per chat with ordered messages.

    `first` keeps the first turns only; tasks drop the others before the shuffle, so that a chat of any
    length brings a bounded group.
    """
    if first is not None:
        order = Window.partitionBy("conv_id").orderBy("turn")
        conversations = conversations.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first)
    return conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    )


def _piece(message: Column, last: Column, eos: str) -> Column:
    role, text = message["role"], message["text"]
    tail = F.when(role == "assistant", F.when(last, F.lit(eos)).otherwise(F.lit(eos + "\n"))).otherwise(
        F.lit("\n")
    )
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, tail)


def rendered(messages: Column | str, bos: str = "", eos: str = "", prompt: bool = False) -> Column:
    """The whole chat as text; roles outside ROLES leave no trace."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    size = F.size(messages)
    pieces = F.transform(
        messages,
        lambda m, i: F.when(m["role"].isin(*ROLES), _piece(m, i == size - 1, eos)).otherwise(F.lit("")),
    )
    end = F.when(size > 0, F.lit("<|assistant|>\n")).otherwise(F.lit("")) if prompt else F.lit("")
    return F.concat(F.lit(bos), F.array_join(pieces, ""), end)


def render_chat(
    conversations: DataFrame, bos: str = "", eos: str = "", generation_prompt: bool = False
) -> DataFrame:
    """(conv_id, text)."""
    return as_messages(conversations).select(
        "conv_id", rendered("messages", bos, eos, generation_prompt).alias("text")
    )


def assistant_labels(
    conversations: DataFrame, mode: str = "offset", max_len: int = 4096, eos: str = ""
) -> DataFrame:
    """(conv_id, tokens, unmasked): which tokens of the rendered chat belong to assistant answers.

    mode "offset" marks every answer where it stands. mode "first_match" marks, per answer, the first
    place where its terms occur, so a repeated answer marks one span and a cut answer marks none.
    Every turn that is rendered has a token, so max_len of those turns are enough for "offset"; "first_match" reads
    the answers of all turns, since a late answer may occur early.
    """
    chats = as_messages(conversations.where(F.col("role").isin(*ROLES)), first=max_len if mode == "offset" else None)
    if mode == "offset":
        turn = F.transform(
            "messages",
            lambda m: F.struct(
                F.concat(F.array(F.concat(F.lit("<|"), m["role"], F.lit("|>"))), terms_of(m["text"])).alias("tokens"),
                F.concat(
                    F.array(F.lit(False)),
                    F.transform(terms_of(m["text"]), lambda _: m["role"] == "assistant"),
                ).alias("unmasked"),
            ),
        )
        if eos:
            raise ValueError("an end mark sticks to the last term: use first_match or an empty mark")
        both = chats.select("conv_id", turn.alias("turns"))
        return both.select(
            "conv_id",
            F.slice(F.flatten(F.transform("turns", lambda t: t["tokens"])), 1, max_len).alias("tokens"),
            F.slice(F.flatten(F.transform("turns", lambda t: t["unmasked"])), 1, max_len).alias("unmasked"),
        )
    if mode != "first_match":
        raise ValueError(f"unknown mode {mode!r}")
    answers = F.filter(
        F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: terms_of(m["text"])),
        lambda answer: F.size(answer) > 0,
    )
    tokens = F.slice(terms_of(rendered("messages", eos=eos)), 1, max_len)
    return _with_first_matches(chats.select("conv_id", tokens.alias("tokens"), answers.alias("answers")))


def first_matches(tokens: Sequence[str], answers: Sequence[Sequence[str]]) -> np.ndarray:
    """Flags of the tokens that lie in the first occurrence of an answer, in time linear in tokens and answers.

    The answers' terms, as numbers, form a tree. Each node's prefix function leads to the longest proper suffix of what has been
    read that also begins an answer, so that one pass over the tokens finds all answers. An answer that has been found is
    passed over from then on. A difference array turns the places into flags.
    """
    number: dict[str, int] = {}
    step: list[dict[int, int]] = [{}]
    length = [0]  # of the answer that ends at a node, 0 if none does
    depth = [0]
    for answer in answers:
        node = 0
        for term in answer:
            term = number.setdefault(term, len(number))
            if term not in step[node]:
                step[node][term] = len(step)
                step.append({})
                length.append(0)
                depth.append(depth[node] + 1)
            node = step[node][term]
        length[node] = depth[node]
    suffix = [0] * len(step)  # the prefix function
    ends = [0] * len(step)  # nearest node on the way of suffixes where an answer ends
    queue = deque(step[0].values())
    while queue:
        node = queue.popleft()
        for term, child in step[node].items():
            back = suffix[node]
            while back and term not in step[back]:
                back = suffix[back]
            suffix[child] = step[back].get(term, 0)
            queue.append(child)
        ends[node] = suffix[node] if length[suffix[node]] else ends[suffix[node]]
    change = np.zeros(len(tokens) + 1, np.int64)
    node = 0
    for at, token in enumerate(tokens, 1):
        term = number.get(token, -1)
        while node and term not in step[node]:
            node = suffix[node]
        node = step[node].get(term, 0)
        found = node if length[node] else ends[node]
        passed = [node]
        while found:
            if length[found]:
                change[at - length[found]] += 1
                change[at] -= 1
                length[found] = 0
            passed.append(found)
            found = ends[found]
        for seen in passed:  # nothing is left to find there
            ends[seen] = 0
    return np.cumsum(change[:-1]) > 0


def _with_first_matches(chats: DataFrame) -> DataFrame:
    """Add `unmasked` to (conv_id, tokens, answers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, CHATS_PER_STEP):
            flags = [first_matches(t, a) for t, a in zip(batch["tokens"].to_pylist(), batch["answers"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["tokens"], pa.array([f.tolist() for f in flags], pa.list_(pa.bool_()))], names=["conv_id", "tokens", "unmasked"])

    found = chats.select("conv_id", "tokens", "answers")
    schema = found.select("conv_id", "tokens", F.array().cast("array<boolean>").alias("unmasked")).schema
    return found.mapInArrow(run, schema)


def with_labels(masked: DataFrame) -> DataFrame:
    """Add input_ids and labels; labels are MASKED outside the answers."""
    return masked.withColumn("input_ids", token_ids("tokens")).withColumn(
        "labels",
        F.zip_with("input_ids", "unmasked", lambda i, keep: F.when(keep, i).otherwise(F.lit(MASKED).cast("bigint"))),
    )


def drop_fully_masked(df: DataFrame, column: str = "labels") -> DataFrame:
    """Keep rows with at least one label to learn from."""
    return df.where(F.exists(column, lambda x: x != MASKED))


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply `fn(pandas frame) -> pandas frame` batch by batch; add row numbers first if it needs them.

    Of plain columns at most ROWS_PER_STEP rows are a frame at a time; other types need Spark's own conversion.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    if not {f.dataType.simpleString() for f in (*df.schema, *out)} <= PLAIN_TYPES:
        return df.mapInPandas(lambda batches: map(fn, batches), schema)
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, ROWS_PER_STEP):
            frame = fn(batch.to_pandas())
            if set(frame.columns) != set(kinds.names):
                raise ValueError(f"columns {list(frame.columns)} do not match {kinds.names}")
            yield from pa.Table.from_pandas(frame, kinds, preserve_index=False, safe=False).to_batches()

    return df.mapInArrow(run, schema)


def find_conversations(chats: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of `chats(conv_id, text)` whose whole text equals a target text, by digest then recheck."""
    wanted = targets.select("target_id", F.col("text").alias("wanted")).withColumn("digest", F.sha2("wanted", 256))
    return (
        chats.withColumn("digest", F.sha2("text", 256))
        .join(wanted, "digest")
        .where(F.col("text") == F.col("wanted"))
        .select("target_id", "conv_id")
    )
