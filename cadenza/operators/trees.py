"""Questions, entropy gains and tying by decision tree; trees are small tables, data are counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_mass(n: Column, total: Column) -> Column:
    """Aggregate: the count-weighted entropy in bits of shares n/total above 1e-8."""
    p = n / total
    return -F.sum(F.when(p > 1e-8, n * F.log2(p)).otherwise(0.0))


def _weighted(counts: DataFrame, by: list[str], outcome: str, n: str) -> DataFrame:
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    summed = counts.groupBy(*by, outcome).agg(F.sum(n).alias("n")).withColumn("t", F.sum("n").over(whole))
    return summed.groupBy(*by).agg(entropy_mass(F.col("n"), F.col("t")).alias("h"))


def question_gains(counts: DataFrame, context: str, outcome: str, n: str, questions: DataFrame) -> DataFrame:
    """question, gain: entropy of the whole less that of the yes and no parts; questions that don't split are left out.

    counts: context, outcome, n, already aggregated; questions: question, member (a context that answers yes).
    """
    asked = counts.crossJoin(questions.select("question").distinct()).join(
        questions.select("question", F.col("member").alias(context), F.lit(True).alias("yes")), ["question", context], "left"
    ).withColumn("yes", F.coalesce("yes", F.lit(False)))
    parts = _weighted(asked, ["question", "yes"], outcome, n)
    whole = _weighted(counts, [], outcome, n).select(F.col("h").alias("whole"))
    split = parts.groupBy("question").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("sides")).filter("sides = 2")
    return split.crossJoin(whole).select("question", (F.col("whole") - F.col("h")).alias("gain"))


def best_question(counts: DataFrame, context: str, outcome: str, n: str, questions: DataFrame) -> DataFrame:
    """The question of highest gain; ties go to the first by name. No row if none splits."""
    gains = question_gains(counts, context, outcome, n, questions)
    return gains.orderBy(F.desc("gain"), "question").limit(1)


def grow(counts: DataFrame, context: str, outcome: str, n: str, questions: DataFrame, leaves: int, least: float = 0.0) -> list[dict]:
    """Nodes (node, question, yes, no) of a tree that splits its best leaf until there are leaves of them.

    The loop runs over the tree's few leaves; each step is one aggregate over the counts.
    """
    nodes: list[dict] = []
    parts = {0: counts}
    best = {0: best_question(counts, context, outcome, n, questions).collect()}
    while len(parts) < leaves:
        open_ = [(rows[0]["gain"], -node, rows[0]["question"]) for node, rows in best.items() if rows]
        if not open_ or max(open_)[0] <= least:
            break
        _, node, question = max(open_)
        node = -node
        members = questions.filter(F.col("question") == question).select(F.col("member").alias(context))
        data = parts.pop(node)
        best.pop(node)
        yes, no = 2 * len(nodes) + 1, 2 * len(nodes) + 2
        nodes.append({"node": node, "question": question, "yes": yes, "no": no})
        for child, how in ((yes, "left_semi"), (no, "left_anti")):
            parts[child] = data.join(members, context, how)
            best[child] = best_question(parts[child], context, outcome, n, questions).collect()
    return nodes


def tie(rows: DataFrame, context: str, nodes: list[dict], members: dict[str, list[str]]) -> DataFrame:
    """rows with leaf: the tree's questions become one nested CASE, no join."""
    by = {x["node"]: x for x in nodes}

    def walk(node: int) -> Column:
        if node not in by:
            return F.lit(node)
        x = by[node]
        return F.when(F.col(context).isin(*members[x["question"]]), walk(x["yes"])).otherwise(walk(x["no"]))

    return rows.withColumn("leaf", walk(0))


def agreement(left: DataFrame, right: DataFrame, subject: str, context: str, part: str) -> DataFrame:
    """One row a subject: how two partitions of its contexts agree, whatever the names of the parts.

    left and right: subject, context, part, one row a context. subject, equal, common, left_only, right_only
    (contexts), left_parts, right_parts, pairs (of common contexts) and disagreements (pairs together in
    one partition only). Pairs are counted from groupings, never listed.
    """
    two = lambda n: n * (n - 1) / 2
    b = right.select(F.col(subject).alias("s"), F.col(context).alias("c"), F.col(part).alias("q"), F.lit(True).alias("in_right"))
    a = left.select(F.col(subject).alias("s"), F.col(context).alias("c"), F.col(part).alias("p"), F.lit(True).alias("in_left"))
    joint = a.join(b, ["s", "c"], "full_outer").withColumn("both", F.col("in_left").isNotNull() & F.col("in_right").isNotNull())
    cells = joint.groupBy("s", "p", "q", "both").agg(F.count(F.lit(1)).alias("n"), F.count("in_left").alias("l"), F.count("in_right").alias("r"))
    common = cells.filter("both")
    each = lambda by, name: common.groupBy("s", by).agg(F.sum("n").alias("n")).groupBy("s").agg(F.sum(two(F.col("n"))).alias(f"{name}_pairs"), F.count(F.lit(1)).alias(f"{name}_parts"))
    shared = common.groupBy("s").agg(F.sum(two(F.col("n"))).alias("joint_pairs"))
    sizes = cells.groupBy("s").agg(
        F.sum(F.when(F.col("both"), F.col("n")).otherwise(0)).alias("common"), F.sum(F.when(~F.col("both"), F.col("l")).otherwise(0)).alias("left_only"),
        F.sum(F.when(~F.col("both"), F.col("r")).otherwise(0)).alias("right_only"),
    )
    known = sizes.join(each("p", "left"), "s", "left").join(each("q", "right"), "s", "left").join(shared, "s", "left").na.fill(0)
    off = (F.col("left_pairs") + F.col("right_pairs") - 2 * F.col("joint_pairs")).cast("long")
    return known.select(
        F.col("s").alias(subject), ((F.col("left_only") == 0) & (F.col("right_only") == 0) & (off == 0)).alias("equal"), "common", "left_only", "right_only",
        "left_parts", "right_parts", two(F.col("common")).cast("long").alias("pairs"), off.alias("disagreements"),
    )


def compound(terms: list[list[tuple[str, list[str], bool]]]) -> Column:
    """A question made of others: any of the terms, each all of its parts (column, members, negated). No term: never; an empty term: always."""
    answer = F.lit(False)
    for term in terms:
        holds = F.lit(True)
        for column, members, negated in term:
            own = F.coalesce(F.col(column).isin(*members), F.lit(False)) if members else F.lit(False)
            holds = holds & (~own if negated else own)
        answer = answer | holds
    return answer
