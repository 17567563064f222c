"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import pick

EXAMPLES = "conv_id long, example int, n_turns long, text string, loss_start long, loss_end long, last boolean"
CHARS_AT_ONCE = 1 << 22
# Control strings of the template. Any of them inside a text begins with "<|", where escape() puts a backslash.
ROLE, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """No control string is left: one more backslash between < and |, however many are there."""
    return _OPEN.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(lambda m: f"<{m[1]}|", text)


def _expand(rows: pd.Series):
    """(n_turns, text, loss_start, loss_end, last) of one example after the other."""
    prefix: list[str] = []
    size = 0
    targets = [k for k, turn in enumerate(rows, 1) if turn["role"] == "assistant"]
    final = len(rows)
    for k, turn in enumerate(rows, 1):
        head = f"{ROLE}{escape(turn['role'] or '')}{BODY}"
        body = escape(turn["text"] or "")
        prefix.append(f"{head}{body}{END}")
        begin = size + len(head)
        size += len(prefix[-1])
        if turn["role"] == "assistant":
            yield k, "".join(prefix), begin, begin + len(body), k == final
    if not targets or targets[-1] < final:
        yield final, "".join(prefix), 0, 0, True


def prefix_targets(turns: DataFrame) -> DataFrame:
    """One row per training example: (conv_id, example, n_turns, text, loss_start, loss_end, last).

    Every assistant turn is an example: all turns before it as context and its own text, [loss_start,
    loss_end) in code points, as the only trainable part. Turns after the last assistant turn form one
    more example without a trainable part, so that no turn is lost; last marks the example that has all turns. Turns are ordered by (turn, role,
    text), nulls first; null role or text is empty, repeated rows are repeated turns, a null conv_id is
    a conversation of its own; other columns are not read; an empty table gives no rows. The texts grow with the square of a
    conversation's turns, as the expansion is defined; a conversation's turns meet in one task, as they must in its last
    example, but its examples leave one after the other.
    """

    def expand(batches):
        for pdf in batches:
            for conv_id, rows in zip(pdf["conv_id"], pdf["rows"], strict=True):
                part, chars = [], 0
                for i, made in enumerate(_expand(rows)):
                    part.append((None if pd.isna(conv_id) else conv_id, i, *made))
                    chars += len(made[1])
                    if chars > CHARS_AT_ONCE:
                        yield _frame(part, EXAMPLES)
                        part, chars = [], 0
                yield _frame(part, EXAMPLES)

    rows = pick(turns, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return grouped.mapInPandas(expand, EXAMPLES)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def chat_digest(examples: DataFrame) -> DataFrame:
    """What the formatted examples of each conversation say, read back from their texts and loss spans.

    Each example is read where it is made; only its length and its trainable text go on, whose sum is no longer than
    the conversation, and from the last example the number of turns and their hash.
    """
    schema = "conv_id long, example int, loss string, chars long, n_turns long, turns_sha256 string"

    def read(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                loss = unescape(x.text[x.loss_start : x.loss_end])
                turns, said = [], None
                if x.last:
                    turns = parse_turns(x.text)
                    said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                out.append((None if pd.isna(x.conv_id) else x.conv_id, x.example, loss, len(x.text), len(turns), said))
            yield _frame(out, schema)

    rows = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "last").mapInPandas(read, schema)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"])
    sums = (F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    told = rows.groupBy("conv_id").agg(F.array_join(parts, "").alias("loss"), *sums)
    return told.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two texts are made of control strings of common templates."""
    spark: SparkSession = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return pick(turns, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}).union(probe)
