"""Joins of findings: correlation with runtime observations, related findings, knowledge, triage, validations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import exprs, rules
from siltstone.operators.score import limit_per
from siltstone.sources.shared import kept
from siltstone.sources.tables import fixed

SUPPORTS, RELATED, SKILLS = 5, 8, 5


def first_static(enriched: DataFrame) -> DataFrame:
    """(family, ord, id): the first static rows of each family."""
    return limit_per(enriched.where("scanner <> 'runtime'").select("family", "ord", "id"), ["family"], ["ord"], SUPPORTS)


def supports(enriched: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """(id, ord, support_id, place): for each runtime row the first static ids of its family, or those given; static rows are cut before the join."""
    static = first_static(enriched) if static is None else static
    place = F.row_number().over(Window.partitionBy("family").orderBy("s_ord"))
    static = static.select("family", F.col("ord").alias("s_ord"), F.col("id").alias("support_id")).withColumn("place", place)
    return enriched.where("scanner = 'runtime'").select("id", "ord", "family").join(static, "family").select("id", "ord", "support_id", "place")


LINK = "struct<p:int,t_ord:bigint,target:string>"
#: Relations in order of precedence. Fixed values.
RELATIONS = ["same-artifact", "same-library", "runtime-observed", "same-family"]


#: What the links of a row depend on, besides the other rows.
LINKED = ["id", "scanner", "file_path", "library", "family"]


def linked_once(enriched: DataFrame) -> DataFrame:
    """(LINKED, ord): rows that have the same links, as one with their first ord; kept, as links ask for it several times. Lists of ids by their
    first ord are alike from it; the first static rows of a family are not, and come from all rows."""
    return kept(enriched.groupBy(*LINKED).agg(F.min("ord").alias("ord")), "linked")


def related(enriched: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """(ord, id, target, relation, place): at most RELATED links of a row, by relation, then order of the target. static: first_static of all rows, where
    enriched has each of linked_once only.

    Of each artifact only the first RELATED + 1 ids can matter, of a library and of what other scanners say of a family the first
    2 * RELATED, as a row meets itself once and what earlier relations took at most RELATED times. So each key has one row with
    a short list; a finding looks up its four lists, and sorts and cuts them in a projection: nothing is exploded or grouped.
    """
    rows = enriched.select("ord", "id", "scanner", "file_path", "library", "family")

    def listed(found: DataFrame, keys: list[str], n: int, p: int) -> DataFrame:
        one = found.groupBy(*keys, "id").agg(F.min("ord").alias("t_ord"))
        cut = limit_per(one, keys, ["t_ord", "id"], n)
        return cut.groupBy(*keys).agg(F.collect_list(F.struct(F.lit(p).alias("p"), "t_ord", F.col("id").alias("target"))).alias(f"l{p}"))

    scanners = rows.select("scanner").distinct().withColumnRenamed("scanner", "mine")
    firsts = limit_per(rows.groupBy("family", "scanner", "id").agg(F.min("ord").alias("ord")), ["family", "scanner"], ["ord", "id"], 2 * RELATED)
    others = firsts.join(F.broadcast(scanners), F.col("scanner") != F.col("mine")).select("family", F.col("mine").alias("scanner"), "id", "ord")  # a handful of scanners
    seen = supports(enriched, static).select(F.col("support_id").alias("s_id"), "id", "ord")
    lists = [(listed(rows, ["file_path"], RELATED + 1, 0), ["file_path"]), (listed(rows.where("library <> ''"), ["library"], 2 * RELATED, 1), ["library"]),
             (listed(seen, ["s_id"], 2 * RELATED, 2).withColumnRenamed("s_id", "id"), ["id"]), (listed(others, ["family", "scanner"], 2 * RELATED, 3), ["family", "scanner"])]
    for found, keys in lists:
        rows = rows.join(found, keys, "left")
    none = F.array().cast(f"array<{LINK}>")
    every = F.array_sort(F.filter(F.concat(*[F.coalesce(f"l{p}", none) for p in range(4)]), lambda x: x["target"] != F.col("id")))
    best = F.aggregate(every, none, lambda kept, x: F.when((F.size(kept) < RELATED) & ~F.exists(kept, lambda y: y["target"] == x["target"]), F.concat(kept, F.array(x))).otherwise(kept))
    near = F.filter("l0", lambda x: x["target"] != F.col("id"))  # different ids already; if they are enough, the other lists can't count
    best = F.when(F.size(near) >= RELATED, F.slice(F.array_sort(near), 1, RELATED)).otherwise(best)
    out = rows.select("ord", "id", F.posexplode(best).alias("at", "l"))
    return out.select("ord", "id", "l.target", F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("l.p") + 1).alias("relation"), (F.col("at") + 1).alias("place"))


def knowledge(enriched: DataFrame, *carry: str) -> DataFrame:
    """(ord, id, skill, strength, place, and the columns carried): allow-list matches, the first SKILLS by rank.

    What matches depends on four columns only, so the registry, a fixed table of a few dozen rows, is matched with the distinct
    combinations of these; findings look their combination's short list up. There are as many as the words of rules and scanners allow, however many
    findings; so they are broadcast, and findings aren't shuffled by a few skewed keys."""
    what = ["algorithm", "scanner", "category", "usage"]
    name, scanner, category, usage = map(F.col, what)
    keys = F.array(F.upper(name), exprs.base_algorithm(name), exprs.family(name))
    scanners = F.when(category == "dependency", F.array(scanner, F.lit("dependency"))).otherwise(F.array(scanner))
    kinds = enriched.select(*what, keys.alias("keys"), scanners.alias("scanners")).distinct()
    some = "array<string>"
    registry = fixed(enriched.sparkSession, [(k, *s) for k, s in enumerate(rules.SKILLS)], f"k int, skill string, tier int, algorithms {some}, in_scanners {some}, categories {some}, usages {some}")
    empty = lambda c: F.size(c) == 0
    hit = F.arrays_overlap("keys", "algorithms")
    applies = ((empty("algorithms") | hit | (F.col("skill") == "crypto-audit")) & (empty("in_scanners") | F.arrays_overlap("scanners", "in_scanners"))
               & (empty("categories") | F.array_contains("categories", category)) & (empty("usages") | F.array_contains("usages", usage)))
    rank = F.when(hit, F.col("k")).otherwise(1_000_000 + F.col("tier") * 10_000 + F.greatest(F.lit(1), F.size("in_scanners")) * 100 + F.col("k"))
    matched = kinds.join(F.broadcast(registry), applies).groupBy(*[c.alias(f"_{n}") for c, n in zip((name, scanner, category, usage), what, strict=True)]).agg(
        F.slice(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "skill", F.when(hit, "HIGH").otherwise("MEDIUM").alias("strength")))), 1, SKILLS).alias("best"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in what]
    return enriched.join(F.broadcast(matched), same).select("ord", "id", *carry, F.posexplode("best").alias("at", "m")).select("ord", "id", "m.skill", "m.strength", (F.col("at") + 1).alias("place"), *carry)


def registry(spark, skills=None) -> DataFrame:
    """(place, skill, tier, algorithms, scanners, categories, usages): the registry as a table."""
    some = "array<string>"
    return spark.createDataFrame([(k, *s) for k, s in enumerate(rules.SKILLS if skills is None else skills)], f"place int, skill string, tier int, algorithms {some}, scanners {some}, categories {some}, usages {some}")


def registry_info(skills: DataFrame) -> DataFrame:
    """(skills, tier1, tier2) of a registry."""
    return skills.agg(F.count(F.lit(1)).alias("skills"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2)])


def registry_problems(skills: DataFrame) -> DataFrame:
    """(problem): repeated ids, tiers other than 1 and 2, lists that are missing."""
    found = [skills.groupBy("skill").count().where("count > 1").select(F.concat(F.col("skill"), F.lit(": duplicate id")).alias("problem")),
             skills.where("tier is null or tier not in (1, 2)").select(F.concat("skill", F.lit(": bad tier")))]
    found += [skills.where(F.col(c).isNull()).select(F.concat("skill", F.lit(f": bad applies.{c}"))) for c in ("algorithms", "scanners", "categories", "usages")]
    return reduce(DataFrame.union, found)


def direction_skills(enriched: DataFrame) -> DataFrame:
    """(direction, skills): the skills matched by findings of each recommended direction, in the order first seen."""
    by_place = knowledge(enriched, "recommend").groupBy("recommend", "skill", "place").agg(F.min("ord").alias("ord"))  # hashed; a least pair would sort all rows
    first = by_place.groupBy("recommend", "skill").agg(F.min(F.struct("ord", "place")).alias("first"))
    return first.groupBy(F.col("recommend").alias("direction")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "skill"))), lambda x: x["skill"]), ",").alias("skills"))


def triaged(enriched: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with the state recorded for their fingerprint, open where there is none."""
    return enriched.join(triage, "fp", "left").withColumn("triage", F.coalesce("triage", F.lit("open")))


#: States of triage, what older names became, reasons that a suppression may have. Fixed values.
TRIAGE = ["open", "triaged", "planned", "in_progress", "fixed", "verified", "suppressed"]
OLD_TRIAGE = {"reviewed": "triaged", "resolved": "verified"}
REASONS = ["false-positive", "intentional-architecture", "accepted-risk", "not-applicable", "duplicate", "deferred", "other"]


def migrated_triage(state: F.Column) -> F.Column:
    """The state's name of today."""
    out = state
    for old, new in OLD_TRIAGE.items():
        out = F.when(state == old, new).otherwise(out)
    return out


def triage_fault(state: F.Column, fingerprint: F.Column, reason: F.Column) -> F.Column:
    """Why an entry (state as migrated) can't be recorded; null if it can."""
    return (F.when(~F.coalesce(state.isin(TRIAGE), F.lit(False)), F.concat(F.lit("unknown triage status '"), F.coalesce(state, F.lit("")), F.lit("'")))
            .when((F.coalesce(fingerprint, F.lit("")) == "") | (F.length(fingerprint) > 64), "fingerprint is required")
            .when((state == "suppressed") & ~F.coalesce(reason.isin(REASONS), F.lit(False)), "suppression requires a reason"))


def validation_rollup(enriched: DataFrame, results: DataFrame) -> DataFrame:
    """(ord, id, validation_status): by results that name the finding, else by a runtime observation of its family."""
    flag = lambda s: F.max((F.col("v_status") == s).cast("int"))
    own = results.where("finding_id is not null and finding_id <> ''").groupBy("finding_id").agg(
        flag("CONFIRMED").alias("c"), flag("PARTIALLY_CONFIRMED").alias("p"), flag("OBSERVED").alias("o"), F.min((F.col("v_status") == "NOT_APPLICABLE").cast("int")).alias("n"))
    seen = results.where("validation_type = 'runtime' and v_status in ('OBSERVED', 'CONFIRMED')").select(exprs.family(F.col("observed_algorithm")).alias("family"), F.lit(True).alias("seen")).distinct()
    rows = enriched.select("ord", "id", "family", "usage").join(own, F.col("id") == F.col("finding_id"), "left").join(seen, "family", "left")
    status = (F.when(F.col("c").isNull(), F.when(F.col("seen"), "RUNTIME_OBSERVED").when(F.col("usage") == "dependency integrity metadata", "NOT_APPLICABLE").otherwise("STATIC_ONLY"))
              .when(F.col("c") == 1, "RUNTIME_CONFIRMED").when(F.col("p") == 1, "RUNTIME_CORRELATED").when(F.col("o") == 1, "RUNTIME_OBSERVED")
              .when(F.col("n") == 1, "NOT_APPLICABLE").otherwise("STATIC_ONLY"))
    return rows.select("ord", "id", status.alias("validation_status"))


def unrelated_observations(enriched: DataFrame, results: DataFrame) -> DataFrame:
    """Runtime observations that name no finding and whose family no finding has."""
    free = results.where("validation_type = 'runtime' and (finding_id is null or finding_id = '')").withColumn("family", exprs.family(F.col("observed_algorithm")))
    return free.join(enriched.select("family").distinct(), "family", "left_anti")
