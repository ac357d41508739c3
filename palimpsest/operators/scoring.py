"""Scores of responses against an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import similarity, squeezed, tokens

from .canonical import cut
from .fold import ordered


def records(expected: DataFrame, actual: DataFrame, most: float, task: bool = False, by: str = "case") -> DataFrame:
    """Per case: coverage, correctness (over the expected count) and score 0.65 / 0.35 of records (id, title, status, priority)."""
    a = actual.select(by, "id", *(F.col(c).alias(f"a_{c}") for c in ("title", "status", "priority")), F.lit(1).alias("there"))
    e = expected.select(by, "id", "title", "status", "priority", F.lit(1).alias("wanted"))
    same = lambda c: F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))) == F.lower(F.trim(F.coalesce(f"a_{c}", F.lit("")))), 1.0).otherwise(0.0)
    right = (similarity("title", "a_title") + same("status") + same("priority")) / 3 if task else (similarity("title", "a_title") + same("status")) / 2
    both = F.col("wanted").isNotNull() & F.col("there").isNotNull()
    rows = e.join(a, [by, "id"], "full_outer").groupBy(by).agg(
        F.count("wanted").alias("expected"), F.count("there").alias("actual"), F.count_if(both).alias("matched"), F.coalesce(F.sum(F.when(both, right)), F.lit(0.0)).alias("right")
    )
    none = F.when(F.col("actual") > 0, 0.0).otherwise(1.0)
    rows = rows.withColumn("coverage", F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(none)).withColumn("correctness", F.when(F.col("expected") > 0, F.col("right") / F.col("expected")).otherwise(none))
    return rows.withColumn("score", F.lit(most) * (F.col("coverage") * 0.65 + F.col("correctness") * 0.35)).drop("right")


def status_field(expected, actual, kind: str = "text", points: float = 5.0):
    """Points of one status field: text by similarity, number and exact by equality; an absent expectation wants an absent answer."""
    e, a = F.col(expected).cast("string"), F.col(actual).cast("string")
    blank = lambda x: x.isNull() | (x == "")
    equal = F.col(expected) == F.col(actual) if kind == "number" else F.lower(F.trim(e)) == F.lower(F.trim(a))
    ratio = similarity(e, a) if kind == "text" else F.when(equal, 1.0).otherwise(0.0)
    return F.lit(points) * F.when(blank(e), F.when(blank(a), 1.0).otherwise(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def evidence(expected: DataFrame, cited: DataFrame, known: DataFrame, by: str = "case") -> DataFrame:
    """Per case: 10 points for coverage of expected evidence, 5 for the validity of what is cited."""
    valid = cited.join(known.select("uri", F.lit(1).alias("valid")).distinct(), "uri", "left")
    e = expected.select(by, "uri", F.lit(1).alias("wanted"))
    rows = valid.select(by, "uri", "valid", F.lit(1).alias("cited")).distinct().join(e.distinct(), [by, "uri"], "full_outer").groupBy(by).agg(
        F.count("wanted").alias("expected"), F.count("cited").alias("cited"), F.count("valid").alias("valid"), F.count_if(F.col("wanted").isNotNull() & F.col("valid").isNotNull()).alias("covered")
    )
    coverage = F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")).otherwise(F.when((F.col("valid") > 0) | (F.col("cited") == 0), 1.0).otherwise(0.0))
    validity = F.when(F.col("cited") > 0, F.col("valid") / F.col("cited")).otherwise(F.when(F.col("expected") > 0, 0.0).otherwise(1.0))
    return rows.withColumn("score", 10 * coverage + 5 * validity).withColumn("invalid", F.col("cited") - F.col("valid"))


def verdict(score, critical):
    return F.when(critical, "FAIL").when(score >= 85, "PASS").when(score >= 65, "PARTIAL").otherwise("FAIL")


def _grams(size: int) -> Column:
    last = F.length("x") - (size - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.col("x").substr(i, F.lit(size))))


def alike(one: DataFrame, two: DataFrame, by: str = "case", least: float = 0.55) -> DataFrame:
    """(by, a, b, similarity) of the texts (id, text) of one case in both tables that are similar by ``least`` or more; ids are unique in a case.

    Pairs meet on what they must share.  A text within another has all its grams
    of three characters there, so it looks its rarest one up.  A Dice ratio of t
    wants t / (2 - t) of either text's tokens in common, so two such texts share
    one of their rarest tokens, all but that many.  What meets is scored.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0, at most 1")
    a, b = (cut(df.select(by, F.col("id").alias(k), squeezed("text").alias("x")).withColumn("t", tokens("x"))) for df, k in ((one, "a"), (two, "b")))

    def within(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        """Pairs of which one may hold the other: texts of up to two characters are looked up whole."""
        tiny = F.when(F.length("x") * least <= 2, F.concat(_grams(1), _grams(2), F.array("x"))).otherwise(F.array().cast("array<string>"))
        holds = outer.select(by, o, F.length("x").alias("longer"), F.explode(F.array_distinct(F.concat(_grams(3), tiny))).alias("g"))
        often = holds.groupBy(by, "g").agg(F.count("*").alias("n"))
        asked = inner.select(by, i, F.length("x").alias("shorter"), F.explode(F.when(F.length("x") < 3, F.array("x")).otherwise(F.array_distinct(_grams(3)))).alias("g"))
        rarest = asked.join(often, [by, "g"]).groupBy(by, i, "shorter").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
        return rarest.join(holds, [by, "g"]).where((F.col("shorter") <= F.col("longer")) & (F.col("shorter") >= F.col("longer") * least)).select(by, "a", "b")

    each = [df.select(by, k, F.size("t").alias("size"), F.explode("t").alias("token")) for df, k in ((a, "a"), (b, "b"))]
    often = each[0].select(by, "token").union(each[1].select(by, "token")).groupBy(by, "token").agg(F.count("*").alias("n"))
    share = least / (2 - least)

    def rarest(rows: DataFrame, k: str) -> DataFrame:
        first = F.array_sort(F.collect_list(F.struct("n", "token")))  # a text's tokens, at most MAX_TOKENS
        few = F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
        ranked = rows.join(often, [by, "token"]).groupBy(by, k, "size").agg(first.alias("ts"))
        return ranked.select(by, k, F.col("size").alias(f"{k}_size"), F.posexplode(F.slice("ts", F.lit(1), few.cast("int"))["token"]).alias(f"{k}_at", "token"))

    near = (F.col("b_size") >= F.col("a_size") * share - 1e-9) & (F.col("a_size") >= F.col("b_size") * share - 1e-9)
    # at the first token that two texts share enough must follow in both
    near &= 1 + F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) - 1 >= (F.col("a_size") + F.col("b_size")) * least / 2 - 1e-9
    met = rarest(each[0], "a").join(rarest(each[1], "b"), [by, "token"]).where(near).select(by, "a", "b")
    met = met.union(within(a, "a", b, "b")).union(within(b, "b", a, "a")).distinct()
    rows = met.join(a.select(by, "a", F.col("x").alias("x")), [by, "a"]).join(b.select(by, "b", F.col("x").alias("y")), [by, "b"])
    return rows.select(by, "a", "b", similarity("x", "y").alias("similarity")).where(F.col("similarity") >= least)


def matched(pairs: DataFrame, by: str = "case", least: float = 0.55) -> DataFrame:
    """Greedy best match of scored pairs (case, e, a, score): each expected item in order takes its best free answer, if at ``least``.

    Adds ``taken``.  Pairs stream in the order of expected items; the state is the set of answers taken.
    """

    def step(state, row):
        used, item, done = state
        if row["e"] != item:
            item, done = row["e"], False
        taken = not done and row["a"] not in used and row["score"] >= least
        if taken:
            used, done = used | {row["a"]}, True
        return (used, item, done), (taken,)

    return ordered(pairs, by, ["e", F.desc("score"), "a"], step, lambda: (frozenset(), None, False), "taken boolean")


def listed(expected: DataFrame, actual: DataFrame, by: str = "case") -> DataFrame:
    """(by, score) of lists of texts (id in order, text): the harmonic mean of precision and recall of the greedy best matches; both empty is no row."""
    pairs = alike(expected, actual, by).select(by, F.col("a").alias("e"), F.col("b").alias("a"), F.col("similarity").alias("score"))
    weight = matched(pairs, by).where("taken").groupBy(by).agg(F.sum("score").alias("w"))
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    rows = count(expected, "e").join(count(actual, "a"), by, "full_outer").join(weight, by, "left")
    w = F.coalesce("w", F.lit(0.0))
    return rows.select(by, F.when((F.coalesce("e", F.lit(0)) == 0) | (F.coalesce("a", F.lit(0)) == 0) | (w == 0), 0.0).otherwise(2 * w / (F.col("a") + F.col("e"))).alias("score"))


def evaluated(expected: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """(case, identity, status, decisions, tasks, actions, evidence, score, critical, verdict): answers of receivers held against their answer keys.

    Both have case, project_id, project_title, summary, phase, health, progress,
    decisions and tasks (arrays of id, title, status, priority), blockers,
    next_actions and evidence (arrays of texts); known: uri of evidence that is there.
    An answer that is missing scores as an empty one.  ``critical`` lists a wrong
    project, ids that the key does not have, and evidence that is not there.
    """
    fields = ("project_id", "project_title", "summary", "phase", "health", "progress")
    both = cut(expected.select("case", *(F.col(c).alias(f"e_{c}") for c in fields)).join(answers.select("case", *(F.col(c).alias(f"a_{c}") for c in fields)), "case", "left"))
    answers = answers.join(expected.select("case"), "case", "left_semi")
    same = lambda c: squeezed(f"e_{c}") == squeezed(f"a_{c}")
    identity = F.when(same("project_id"), 5.0).otherwise(0.0) + F.when(same("project_title"), 5.0).otherwise(0.0)
    status = sum((status_field(f"e_{c}", f"a_{c}", kind) for c, kind in (("phase", "text"), ("health", "exact"), ("progress", "number"))), status_field("e_summary", "a_summary"))
    out = both.select("case", identity.alias("identity"), status.alias("status"), F.when(~same("project_id"), "project").alias("wrong_project"))

    def points(rows: DataFrame, score: Column, name: str, most: float) -> None:
        """What a case has no row for is right: nothing was expected, and nothing given."""
        nonlocal out
        out = out.join(rows.select("case", score.alias(name)), "case", "left").withColumn(name, F.coalesce(name, F.lit(most)))

    for name, task in (("decisions", False), ("tasks", True)):
        e, a = (df.select("case", F.inline(name)).dropDuplicates(["case", "id"]) for df in (expected, answers))
        points(records(e, a, 20.0, task), F.col("score"), name, 20.0)
        extra = a.join(e.select("case", "id"), ["case", "id"], "left_anti").select("case", F.lit(f"unsupported_{name}").alias(f"extra_{name}")).distinct()
        out = out.join(extra, "case", "left")
    item = lambda df, name: df.select("case", F.posexplode(name).alias("id", "text"))
    for name in ("blockers", "next_actions"):
        points(listed(item(expected, name), item(answers, name)), 7.5 * F.col("score"), name, 7.5)
    uri = lambda df: df.select("case", F.explode("evidence").alias("uri")).distinct()
    points(evidence(uri(expected), uri(answers), known), F.col("score"), "evidence", 15.0)
    bad = uri(answers).join(known.select("uri"), "uri", "left_anti").select("case", F.lit("invalid_evidence").alias("bad_evidence")).distinct()
    out = out.join(bad, "case", "left").withColumn("actions", F.col("blockers") + F.col("next_actions"))
    names = ("identity", "status", "decisions", "tasks", "actions", "evidence")
    total = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), sum((F.col(c) for c in names), F.lit(0.0)))), 2)
    critical = F.array_compact(F.array("wrong_project", "extra_decisions", "extra_tasks", "bad_evidence"))
    return out.select("case", *(F.round(c, 2).alias(c) for c in names), total.alias("score"), critical.alias("critical"), verdict(total, F.size(critical) > 0).alias("verdict"))


def failures(text):
    """Flags of a failure taxonomy found in a report's text."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), n) for n, p in (("missing", "missing|absent|not found"), ("unsupported", "unsupported|invented|hallucinat"), ("stale", "stale|outdated|superseded"), ("evidence", "evidence|citation")))))
