"""Budgeted packing of evidence: for many answers at once, what fits of their findings and records, and why the rest doesn't.

An answer's findings are folded in a fair order (the first of every requirement before any second one) over a state of
what has been admitted. Then a byte budget is met by leaving out, in this order and each from the end: contexts of
records, records that no finding cites, findings. What remains is the longest beginning that fits, so each step is a
comparison of running sums and not a loop. Coverage follows from what was left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Records, bytes of contexts, findings of a requirement, items of a finding's lists, bytes of a finding,
    bytes of the whole."""

    records: int = 200
    context_bytes: int = 14_000
    findings: int = 25
    items: int = 32
    finding_bytes: int = 16_384
    package_bytes: int = 262_144


def _let(value: Column, body) -> Column:
    """An expression of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _longest(sizes: Column, room: Column) -> Column:
    """How many of the sizes fit the room, from the first on."""
    sums = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.size(F.filter(F.slice(sums, 2, F.greatest(F.size(sizes), F.lit(1))), lambda s: s <= room))


def _admit(limits: Limits):
    def step(state: Column, claim: Column) -> Column:
        union = F.array_union(state["used"], claim["evidence_ids"])
        own = F.size(F.filter(state["kept"], lambda k: k["requirement_id"] == claim["requirement_id"]))
        reason = F.when(own >= limits.findings, "findings_per_requirement").when(claim["items"] > limits.items, "relationship_detail").when(claim["bytes"] > limits.finding_bytes, "finding_size").when(F.size(union) > limits.records, "evidence_records")

        def moved(why: Column) -> Column:
            left = F.struct(claim["finding_id"].alias("finding_id"), claim["requirement_id"].alias("requirement_id"), why.alias("reason"))
            return F.struct(
                F.when(why.isNull(), F.array_union(state["used"], claim["evidence_ids"])).otherwise(state["used"]).alias("used"),
                F.when(why.isNull(), F.concat(state["kept"], F.array(claim))).otherwise(state["kept"]).alias("kept"),
                F.when(why.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(left))).alias("out"),
            )

        return _let(reason, moved)

    return step


def pack(claims: DataFrame, records: DataFrame, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """findings, evidence, omissions and coverage of every answer.

    claims: answer_id, requirement_id, requirement_at (its order), position (unique in the answer), finding_id, evidence_ids,
    items (the longest of its lists), bytes. records: answer_id, evidence_id, bytes, context_bytes, requirement_ids (whose
    operations found it). findings: answer_id, requirement_id, finding_id, position. evidence: answer_id, evidence_id, context
    (whether its context is in). omissions: answer_id, requirement_id, what, reason: findings_per_requirement,
    relationship_detail, finding_size, evidence_records, source_context, serialized_size_context, serialized_size. coverage:
    answer_id, requirement_id, state: satisfied, or partially_satisfied if anything of it was left out.

    Contexts are taken in the order of evidence ids while they fit; one that doesn't is passed over. An answer is one row
    while it is packed: its own findings and records, which the plan's budgets bound. Evidence without a record takes no
    room. An answer without findings still packs its records.
    """
    fair = Window.partitionBy("answer_id", "requirement_id").orderBy("position")
    claim = F.struct("requirement_id", "position", "finding_id", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.col("items").cast("int").alias("items"), F.col("bytes").cast("long").alias("bytes"))
    rows = claims.withColumn("ordinal", F.row_number().over(fair)).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "requirement_at", "position", claim.alias("claim")))).alias("_claims"))
    record = F.struct("evidence_id", F.col("bytes").cast("long").alias("bytes"), F.col("context_bytes").cast("long").alias("context_bytes"), F.coalesce("requirement_ids", F.array().cast("array<string>")).alias("requirement_ids"))
    held = records.groupBy("answer_id").agg(F.array_sort(F.collect_list(record)).alias("_records"))
    rows = rows.join(held, "answer_id", "full_outer")
    none = lambda name, frame: F.coalesce(F.col(name), F.array().cast(frame.schema[name].dataType))
    rows = rows.select("answer_id", F.transform(none("_claims", rows), lambda c: c["claim"]).alias("_claims"), none("_records", rows).alias("_records"))
    kind = rows.schema["_claims"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(kind).alias("kept"), F.array().cast("array<struct<finding_id:string,requirement_id:string,reason:string>>").alias("out"))
    rows = rows.withColumn("_state", F.aggregate("_claims", start, _admit(limits)))
    rows = rows.select("answer_id", "_records", F.col("_state.used").alias("_used"), F.sort_array(F.transform("_state.kept", lambda c: F.struct(c["position"].alias("position"), c["requirement_id"].alias("requirement_id"), c["finding_id"].alias("finding_id"), c["evidence_ids"].alias("evidence_ids"), c["bytes"].alias("bytes")))).alias("_kept"), F.col("_state.out").alias("_out"))

    # records that no finding cites, as many as there is room for
    spare = F.filter("_records", lambda r: ~F.array_contains("_used", r["evidence_id"]) & (F.size(r["requirement_ids"]) > 0))
    rows = rows.withColumn("_spare", spare).withColumn("_room", F.greatest(F.lit(limits.records) - F.size("_used"), F.lit(0)))
    rows = rows.withColumns({"_extra": F.slice("_spare", F.lit(1), F.col("_room")), "_crowded": F.slice("_spare", F.col("_room") + 1, F.greatest(F.size("_spare"), F.lit(1)))})
    cited = F.filter("_records", lambda r: F.array_contains("_used", r["evidence_id"]))
    rows = rows.withColumn("_cited", cited).withColumn("_all", F.array_sort(F.concat("_cited", "_extra")))

    # contexts while they fit, one after another
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<evidence_id:string,bytes:bigint>>").alias("taken"))
    taken = F.aggregate("_all", empty, lambda a, r: F.when((r["context_bytes"] > 0) & (a["sum"] + r["context_bytes"] <= limits.context_bytes), F.struct((a["sum"] + r["context_bytes"]).alias("sum"), F.concat(a["taken"], F.array(F.struct(r["evidence_id"].alias("evidence_id"), r["context_bytes"].alias("bytes")))).alias("taken"))).otherwise(a), lambda a: a["taken"])
    rows = rows.withColumn("_contexts", taken)

    # the byte budget: the longest beginnings that fit
    sizes = lambda name: F.transform(F.col(name), lambda r: r["bytes"])
    budget = F.lit(limits.package_bytes).cast("long")
    rows = rows.withColumns({"_base": _total(sizes("_kept")) + _total(sizes("_cited")), "_more": _total(sizes("_extra"))})
    rows = rows.withColumn("_n_contexts", _longest(sizes("_contexts"), budget - F.col("_base") - F.col("_more")))
    rows = rows.withColumn("_n_extra", F.when(F.col("_base") + F.col("_more") <= budget, F.size("_extra")).otherwise(_longest(sizes("_extra"), budget - F.col("_base"))))
    record_bytes = lambda ids: _total(F.transform(F.filter("_records", lambda r: F.array_contains(ids, r["evidence_id"])), lambda r: r["bytes"]))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_kept"), F.lit(1))), lambda n: _total(F.transform(F.slice("_kept", F.lit(1), n), lambda c: c["bytes"])) + record_bytes(F.flatten(F.transform(F.slice("_kept", F.lit(1), n), lambda c: c["evidence_ids"]))))
    fits = F.least(F.size(F.filter(whole, lambda s: s <= budget)), F.size("_kept"))
    rows = rows.withColumn("_n_kept", F.when(F.col("_base") <= budget, F.size("_kept")).otherwise(fits))
    first = lambda name, n: F.slice(F.col(name), F.lit(1), F.col(n))
    after = lambda name, n: F.slice(F.col(name), F.col(n) + 1, F.greatest(F.size(name), F.lit(1)))
    rows = rows.withColumns({"_findings": first("_kept", "_n_kept"), "_lost": after("_kept", "_n_kept"), "_shown": first("_contexts", "_n_contexts"), "_hidden": after("_contexts", "_n_contexts"), "_extra_in": first("_extra", "_n_extra"), "_extra_out": after("_extra", "_n_extra")})
    rows = rows.withColumn("_in", F.array_union(F.flatten(F.transform("_findings", lambda c: c["evidence_ids"])), F.transform("_extra_in", lambda r: r["evidence_id"])))

    findings = rows.select("answer_id", F.explode("_findings").alias("c")).select("answer_id", "c.requirement_id", "c.finding_id", "c.position")
    shown = F.transform("_shown", lambda c: c["evidence_id"])
    evidence = rows.select("answer_id", shown.alias("shown"), F.explode("_in").alias("evidence_id")).select("answer_id", "evidence_id", F.array_contains("shown", F.col("evidence_id")).alias("context"))
    event = lambda requirement, what, reason: F.struct(requirement.alias("requirement_id"), what.alias("what"), reason.alias("reason"))
    of_record = lambda name, reason: F.flatten(F.transform(F.col(name), lambda r: F.transform(r["requirement_ids"], lambda q: event(q, r["evidence_id"], F.lit(reason)))))
    users = lambda key: F.array_union(F.flatten(F.transform(F.filter("_records", lambda r: r["evidence_id"] == key), lambda r: r["requirement_ids"])), F.transform(F.filter("_kept", lambda c: F.array_contains(c["evidence_ids"], key)), lambda c: c["requirement_id"]))
    of_context = lambda keys, reason: F.flatten(F.transform(keys, lambda key: F.transform(users(key), lambda q: event(q, key, F.lit(reason)))))
    passed = F.filter(F.transform(F.filter("_all", lambda r: r["context_bytes"] > 0), lambda r: r["evidence_id"]), lambda k: ~F.exists("_contexts", lambda c: c["evidence_id"] == k))
    events = F.concat(
        F.transform("_out", lambda o: event(o["requirement_id"], o["finding_id"], o["reason"])),
        of_record("_crowded", "evidence_records"),
        of_context(passed, "source_context"),
        of_context(F.transform("_hidden", lambda c: c["evidence_id"]), "serialized_size_context"),
        of_record("_extra_out", "serialized_size"),
        F.transform("_lost", lambda c: event(c["requirement_id"], c["finding_id"], F.lit("serialized_size"))),
    )
    omissions = rows.select("answer_id", F.explode(events).alias("e")).select("answer_id", "e.*").distinct()
    asked = claims.select("answer_id", "requirement_id").union(records.select("answer_id", F.explode("requirement_ids"))).distinct()
    touched = omissions.select("answer_id", "requirement_id").distinct().withColumn("touched", F.lit(True))
    coverage = asked.join(touched, ["answer_id", "requirement_id"], "left").select("answer_id", "requirement_id", F.when(F.col("touched"), "partially_satisfied").otherwise("satisfied").alias("state"))
    return {"findings": findings, "evidence": evidence, "omissions": omissions, "coverage": coverage}
