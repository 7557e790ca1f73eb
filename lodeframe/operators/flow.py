"""Control-flow graphs: basic blocks and the edges between them.

Methods are partitions: their code has at most 65,535 instructions, so a window over one is bounded. Blocks are numbered by
a running sum over leaders; edges are joins of last instructions with the blocks that their targets begin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lodeframe.operators.graph import closure
from lodeframe.plans.scratch import materialize
from lodeframe.sources.bytecode import JUMPS, RETURNS

METHOD = ("full_path", "method_pos")
GOTO = ("goto", "goto_w")
#: Nothing follows these.
ENDS = tuple(sorted(RETURNS)) + ("athrow",)
CONDITIONAL = tuple(sorted(JUMPS - {"goto"})) + ("jsr_w",)


def basic_blocks(instructions: DataFrame, handlers: DataFrame | None = None, by: Sequence[str] = METHOD) -> DataFrame:
    """(*by, block from 0, first, last, start, end, n, op, kind, targets): blocks with the places and offsets of their first and last
    instruction, and the operation, kind and targets of the last one.

    ``instructions`` are (*by, at, offset, op, kind, targets), ``handlers`` (*by, start, end, handler, type). A block begins at the first
    instruction, at the target of a jump, a switch or a handler, and after a conditional jump, a switch, a return or a throw.
    """
    by = list(by)
    jumps = instructions.select(*by, F.explode("targets.offset").alias("offset"))
    if handlers is not None:
        jumps = jumps.unionByName(handlers.select(*by, F.col("handler").alias("offset")))
    leads = jumps.distinct().withColumn("lead", F.lit(1))
    order = Window.partitionBy(*by).orderBy("at")
    cuts = F.col("op").isin(*CONDITIONAL, *ENDS) | (F.col("kind") == "switch")
    marked = instructions.select(*by, "at", "offset", "op", "kind", "targets").join(leads, [*by, "offset"], "left")
    begins = F.when(F.col("lead").isNotNull() | F.coalesce(F.lag(cuts).over(order), F.lit(True)), 1).otherwise(0)
    # One sort for all windows: a block is the row before the next one begins, with what its first row has left behind.
    numbered = marked.withColumn("begins", begins).withColumn("row", F.row_number().over(order)).withColumn("block", (F.sum("begins").over(order) - 1).cast("int"))
    head = F.last(F.when(F.col("begins") == 1, F.struct("at", "offset", "row")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = numbered.withColumn("head", head).withColumn("next", F.lead("begins").over(order)).where("next IS NULL OR next = 1")
    n = (F.col("row") - F.col("head.row") + 1).cast("long").alias("n")
    return ends.select(*by, "block", F.col("head.at").alias("first"), F.col("at").alias("last"), F.col("head.offset").alias("start"), F.col("offset").alias("end"), n, "op", "kind", "targets")


def flow_edges(blocks: DataFrame, handlers: DataFrame | None = None, by: Sequence[str] = METHOD) -> DataFrame:
    """(*by, src, dst, label, style) between ``basic_blocks``.

    Jumps and falls through are solid; conditional jumps have a dashed edge ``true`` and one ``false`` to the next block; a table of
    cases has one edge a block, ``case`` or ``n cases``, other switches one a case, and both an edge ``default``. Every block that a handler's
    range touches, its end included, has a dotted edge to the handler, labelled by the simple name of its type or ``any``.
    """
    by = list(by)
    # Blocks and handlers are read several times.
    blocks = materialize(blocks, "blocks")
    handlers = None if handlers is None else materialize(handlers, "handlers")
    starts = blocks.select(*by, F.col("start").alias("offset"), F.col("block").alias("dst"))
    goals = blocks.select(*by, F.col("block").alias("src"), "op", "kind", F.explode("targets").alias("t")).select(*by, "src", "op", "kind", "t.label", "t.offset")
    reached = goals.join(starts, [*by, "offset"])
    switch, default = F.col("kind") == "switch", F.col("label") == "default"
    table = reached.where(switch & ~default & (F.col("op") == "tableswitch")).groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))
    table = table.select(*by, "src", "dst", F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" cases"))).otherwise("case").alias("label"), F.lit("dashed").alias("style"))
    cases = reached.where(switch & (default | (F.col("op") != "tableswitch"))).select(*by, "src", "dst", F.when(default, "default").otherwise("case").alias("label"), F.lit("dashed").alias("style"))
    straight = F.col("op").isin(*GOTO)
    jumps = reached.where(~switch).select(*by, "src", "dst", F.when(straight, "").otherwise("true").alias("label"), F.when(straight, "solid").otherwise("dashed").alias("style"))
    conditional = F.col("op").isin(*CONDITIONAL)
    through = blocks.where(~F.col("op").isin(*GOTO, *ENDS) & (F.col("kind") != "switch"))
    follow = through.select(*by, F.col("block").alias("src"), (F.col("block") + 1).alias("dst"), F.when(conditional, "false").otherwise("").alias("label"), F.when(conditional, "dashed").otherwise("solid").alias("style"))
    follow = follow.join(blocks.select(*by, F.col("block").alias("dst")), [*by, "dst"], "left_semi").select(*by, "src", "dst", "label", "style")
    edges = jumps.unionByName(follow).unionByName(table).unionByName(cases)
    if handlers is None:
        return edges
    to = handlers.select(*by, F.col("start").alias("low"), F.col("end").alias("high"), F.col("handler").alias("offset"), "type").join(starts, [*by, "offset"])
    inside = blocks.select(*by, F.col("block").alias("src"), "start", "end").join(to, by).where("start <= high AND end >= low")
    return edges.unionByName(inside.select(*by, "src", "dst", F.coalesce(F.substring_index("type", "/", -1), F.lit("any")).alias("label"), F.lit("dotted").alias("style")))


def unreachable_blocks(blocks: DataFrame, edges: DataFrame, by: Sequence[str] = METHOD) -> DataFrame:
    """(*by, block) of blocks that no path from the first block reaches."""
    by = list(by)
    node = lambda c: F.struct(*by, F.col(c).alias("block"))
    firsts = blocks.where("block = 0")
    reached = closure(edges.select(node("src").alias("src"), node("dst").alias("dst")), firsts.select(node("block").alias("src"))).select("dst.*")
    return blocks.select(*by, "block").join(reached.unionByName(firsts.select(*by, "block")), [*by, "block"], "left_anti")
