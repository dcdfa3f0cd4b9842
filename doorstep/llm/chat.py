"""Chat formatting: reply trees to conversations with a turn template and a loss mask.

Messages form trees by (conversation, message, parent). Pointer doubling over self-joins gives
every message the sum of scores and the number of messages up to its root; leaves are ranked by
that score (ties: the longer path, then the smaller message id), and the chosen leaves walk up
the stored jumps, so a path of n messages takes about log2(n) joins. Only messages that have not
reached their root take part in a join.

Defined results: a message whose parent is null or missing is a root; messages on a cycle of
parents have no root and are in no conversation. Null text or role is empty. A null
conversation id is an id of its own. Repeated (conversation, message) rows are one message (the
least row). Conversations of one message are formatted; an empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Replacements that leave no control string in a text; undone in reverse order.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _undone(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return _replaced(text, tuple((new, old) for old, new in reversed(pairs)))


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, msg, up): messages of the ``per_tree`` best paths of each tree.

    ``messages``: tree, msg, parent, score. ``up`` counts steps from the leaf.
    """
    base = messages.select("tree", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    nodes = base.select("tree", "msg")
    known = nodes.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    jump = cut(base.join(known, ["tree", "parent"], "left").select(
        "tree", "msg", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("n")))
    parents = jump.where("up IS NOT NULL").select("tree", F.col("up").alias("msg")).distinct()
    leaves = nodes.join(parents, ["tree", "msg"], "left_anti")
    jumps, before = [], -1
    while True:
        live = jump.where("up IS NOT NULL")
        jumps.append(live.select("tree", "msg", "up"))
        left = jumps[-1].count()
        if left in (0, before):
            break
        before = left
        further = jump.select("tree", F.col("msg").alias("up"), F.col("up").alias("up2"),
                              F.col("score").alias("s2"), F.col("n").alias("n2"))
        jump = cut(jump.where("up IS NULL").union(live.join(further, ["tree", "up"]).select(
            "tree", "msg", F.col("up2").alias("up"), F.col("score") + F.col("s2"), F.col("n") + F.col("n2"))))
    ranked = (leaves.join(jump.where("up IS NULL").select("tree", "msg", "score", "n"), ["tree", "msg"])
              .withColumn("rank", F.row_number().over(
                  W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "msg")))
              .where(F.col("rank") <= per_tree))
    path = ranked.select("tree", F.col("msg").alias("leaf"), "rank", "msg", F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(jumps[:-1]):
        path = cut(path.union(path.join(step.withColumnRenamed("up", "to"), ["tree", "msg"]).select(
            "tree", "leaf", "rank", F.col("to").alias("msg"), (F.col("up") + 2 ** k).alias("up"))))
    return path


def formatted(messages: DataFrame, per_tree: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, rank, formatted, loss) with ``loss`` an array of (start, length) in code points.

    ``messages``: conv_id, msg, parent, role, text, score.
    """
    rows = messages.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("tree"), "msg", "parent",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    whole = cut(rows.groupBy("tree", "msg").agg(
        F.min(F.struct("conv_id", "parent", "role", "text", "score")).alias("m")).select("tree", "msg", "m.*"))
    path = best_paths(whole, per_tree)
    head = F.concat(F.lit(START), _replaced(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    body = _replaced(F.col("text"), ESCAPES)
    pieces = path.join(whole, ["tree", "msg"]).select(
        "conv_id", "tree", "rank", "leaf", "up", F.concat(head, body, F.lit(END)).alias("piece"),
        F.length(head).alias("skip"), F.length(body).alias("long"), (F.col("role") == loss_role).alias("masked"))
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)))
    turn = F.struct(F.negative("up").alias("o"), "piece", F.when(
        F.col("masked"), F.struct((F.col("at") + F.col("skip")).alias("start"), F.col("long").cast("long").alias("length"))).alias("m"))
    return (placed.groupBy("tree", "leaf", "rank").agg(F.first("conv_id").alias("conv_id"),
                                                       F.array_sort(F.collect_list(turn)).alias("t"))
            .select("conv_id", "rank", F.array_join(F.col("t.piece"), "").alias("formatted"),
                    F.filter(F.col("t.m"), lambda m: m.isNotNull()).alias("loss")))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (array of role and text) and ``loss_text`` read from the output."""
    parts = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(START) + 1), F.length(part))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(_undone(role, ROLE_ESCAPES).alias("role"),
                        _undone(F.substring(inner, F.length(role) + 2, F.length(inner)), ESCAPES).alias("text"))
    spans = F.transform("loss", lambda m: _undone(
        F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")), ESCAPES))
    return chats.withColumn("turns", F.transform(whole, turn)).withColumn("loss_text", F.array_join(spans, ""))


def by_turns(conversations: DataFrame) -> DataFrame:
    """Rows by turn as chains: each message answers the one before it. Ties go by role and text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "msg", F.row_number().over(order).cast("long")).select(
        "conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text",
        F.lit(1.0).alias("score"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
                                 "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    back = read_back(formatted(by_turns(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP3_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS body,
  replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
