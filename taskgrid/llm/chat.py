"""Chat formatting of reply trees (operator 2), DataFrame functions only.

Iterative self-joins with doubling strides make jump tables (a node and its 2^k-th
ancestor, about log2 of the depth joins), from which every root-to-leaf path is
enumerated; branches are ranked within their tree by the sum of their messages'
scores, and each chosen path becomes one conversation.

Template: ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE`` per message. Inside
texts and roles ``&`` becomes ``&amp;``, ``<|`` becomes ``&lt;|`` (and a line
break in a role ``&nl;``), so no text can hold a control string and the
original is read back exactly. The loss mask is a list of spans (code points of
the formatted text) over the assistants' texts.

Null texts and roles count as empty, null scores as 0. A node whose parent is
null, itself or unknown is a root; a longer cycle raises. Repeated node ids
count once (the smallest role and text). Equal scores rank by leaf id. An empty table
gives no conversation (the query its own one, -1; a given conversation -1 is merged
with that). Texts of any length are kept whole, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")),
                     F.lit("&amp;"), F.lit("&"))


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ... of (tree, node, above): each node's 2^k-th ancestor, where it has one.

    A node of a tree with n nodes has fewer than n ancestors; one that still has some after log2(n) doublings is on
    a cycle, or below one, and raises."""
    from taskgrid.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(nodes.sparkSession)
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p")).distinct()
    out = [nodes.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("above"))
           .filter("above is not null")
           .join(known, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("p")), "left_semi").checkpoint()]
    largest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while out[-1].limit(1).count():
        if 1 << (len(out) - 1) >= largest:
            raise ValueError("parent links form a cycle")
        far = out[-1].select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("above").alias("further"))
        out.append(out[-1].join(far, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("p")))
                   .select("tree", "node", F.col("further").alias("above")).checkpoint())
    return out[:-1]


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for each node on the path to each leaf of ``nodes`` (tree, node, parent); ``up`` counts
    from the leaf.

    Only leaves are expanded, by the binary digits of the distance: from the longest jump to the shortest, every node
    reached so far stays and, where it can, also jumps. So each ancestor is reached once, and the rows are the paths'
    own; nothing is kept per inner node but one ancestor a table."""
    step = nodes.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"))
    at = step.select("tree", "node").join(
        step.select(F.col("tree").alias("t"), F.col("parent").alias("p")).filter("p is not null").distinct(),
        (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    tables = jumps(nodes)
    for k in reversed(range(len(tables))):
        jump = tables[k].select(F.col("tree").alias("t"), F.col("node").alias("p"), "above")
        stay, go = F.struct("node", "up"), F.struct(F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        at = at.join(jump, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left").select(
            "tree", "leaf", F.explode(F.when(F.col("above").isNull(), F.array(stay)).otherwise(F.array(stay, go))).alias("x")
        ).select("tree", "leaf", "x.node", "x.up")
    return at


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, formatted, loss_spans.

    ``messages``: tree, node, parent, role, text, score. The ``best`` branches
    of each tree are formatted (null: all)."""
    m = messages.groupBy("tree", "node").agg(
        F.min("parent").alias("parent"),
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
    long = paths(m.select("tree", "node", "parent")).select("tree", "leaf", "node", (-F.col("up")).alias("k"))
    full = (long.join(m.select("tree", "node", "m"), ["tree", "node"]).groupBy("tree", "leaf")
            .agg(F.sort_array(F.collect_list(F.struct("k", "m.role", "m.text"))).alias("turns"),
                 F.sum("m.score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = full.withColumn("rank", rank)
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    pieces = ranked.withColumn("p", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))))
    tail = END + "\n"
    spans = F.aggregate(
        "p", F.struct(F.lit(0).cast("bigint").alias("at"),
                      F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(tail)).cast("bigint").alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["head"])).cast("bigint").alias("start"),
                (a["at"] + F.length(x["head"]) + F.length(x["body"])).cast("bigint").alias("end")))))
            .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return pieces.select("tree", "leaf", "rank", "score", F.concat_ws("", F.transform(
        "p", lambda x: F.concat(x["head"], x["body"], F.lit(tail)))).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""
    marks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(marks, lambda x: F.struct(
        unescaped(F.substring_index(x, "\n", 1)).alias("role"),
        unescaped(F.substring_index(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x)),
                                    END, 1)).alias("text")))


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Rows of equal turn follow role and text; a null conv_id is a conversation of its own."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(w).cast("bigint")
    return turns.select(F.struct("conv_id").alias("tree"), n.alias("node"),
                        F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(turns: DataFrame) -> DataFrame:
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    out = conversations(from_turns(turns.select("conv_id", "turn", "role", "text").union(extra)))
    back = out.withColumn("turns", read_back(F.col("formatted"))).withColumn(
        "loss", unescaped(F.concat_ws("", F.transform("loss_spans", lambda s: F.substring(
            F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree.conv_id").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;'))
    + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
