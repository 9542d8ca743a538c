"""Bulk proof of findings against what is stored: every proof and claim of many answers is checked by joins.

A finding's evidence is exploded in order, joined with the stored entities, and folded back into one verdict and code each.
Nothing is repaired. The same functions prove a saved answer again, against whatever generation is current by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes, and the kinds of stored entities that a type of evidence may stand on.
ENTITY_KINDS = {"symbol_definition": ("symbol",), "code_chunk": ("chunk",), "source_range": ("symbol", "node"), "call_site": ("relationship",), "graph_relationship": ("relationship",)}
PROOF = {"repository_id": "string", "snapshot_id": "string", "stage_id": "string", "evidence_type": "string", "resolution": "string", "source_hash": "string", "start_line": "int", "end_line": "int", "file_id": "string", "symbol_id": "string"}


@dataclass(frozen=True)
class Context:
    """What an answer is proved against: the repository, its generation, and the stages that are ready in it."""

    repository_id: str
    snapshot_id: str
    stages: tuple[str, ...]


def _first(*cases: tuple[Column, str]) -> Column:
    """The code of the first case that holds; null if none does."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), code).otherwise(out)
    return out


def proof_codes(proofs: DataFrame, entities: DataFrame, context: Context) -> DataFrame:
    """The proofs with kind, source, target, relationship and state (resolution) of their stored entity, and code.

    proofs: finding_id, position, evidence_id and the columns of PROOF; entities: id, kind (chunk, symbol, relationship, node),
    file_id, symbol_id, source_hash, start_line, end_line, resolution, source, target, relationship. code is null for a
    proof that holds, else the first that fails of repository_mismatch, generation_mismatch, stage_mismatch, missing,
    source_hash, source_range, canonical_identity, provenance (its type or resolution is another).
    """
    e = entities.select(F.col("id").alias("evidence_id"), *(F.col(c).alias(f"_{c}") for c in ("kind", "file_id", "symbol_id", "source_hash", "start_line", "end_line", "resolution", "source", "target", "relationship")))
    scope = _first(
        (~F.col("repository_id").eqNullSafe(F.lit(context.repository_id)), "repository_mismatch"),
        (~F.col("snapshot_id").eqNullSafe(F.lit(context.snapshot_id)), "generation_mismatch"),
        (~F.coalesce(F.col("stage_id").isin(*context.stages), F.lit(False)), "stage_mismatch"),
    )
    rows = proofs.withColumn("_scope", scope).join(e, "evidence_id", "left")  # judged before the join, that fewer columns are shuffled
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    kinds = F.create_map(*(x for t, ks in ENTITY_KINDS.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    fits = F.array_contains(kinds[F.col("evidence_type")], F.col("_kind"))
    code = _first(
        (F.col("_kind").isNull(), "missing"),
        (differs("source_hash"), "source_hash"),
        (differs("start_line") | differs("end_line"), "source_range"),
        (differs("file_id") | differs("symbol_id"), "canonical_identity"),
        (~F.coalesce(fits, F.lit(False)) | ((F.col("_kind") == "relationship") & differs("resolution")), "provenance"),
    )
    shape = [*proofs.columns, F.col("_kind").alias("kind"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_relationship").alias("stored_relationship"), F.col("_resolution").alias("state")]
    return rows.select(*shape, F.coalesce("_scope", code).alias("code"))


def _known(nodes: DataFrame) -> DataFrame:
    """by, key, and the node: every node by its id, and of each symbol the first node."""
    node = lambda id, label, symbol: F.struct(id.alias("id"), label.alias("label"), symbol.alias("symbol_id"))
    every = nodes.select(F.lit("id").alias("by"), F.col("id").alias("key"), node(F.col("id"), F.col("label"), F.col("symbol_id")).alias("node"))
    first = nodes.where("symbol_id IS NOT NULL").groupBy("symbol_id").agg(F.min(F.struct("id", "label")).alias("n"))
    return every.unionByName(first.select(F.lit("symbol").alias("by"), F.col("symbol_id").alias("key"), node(F.col("n.id"), F.col("n.label"), F.col("symbol_id")).alias("node")))


def _claim(by: Column, key: Column, symbol: Column, name: Column, step: Column | None = None, entity: Column | None = None) -> Column:
    """What is said of one node: its symbol and name (null: nothing), its name as a step of a path, the entity that it is."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    is_step, is_entity = (no if c is None else F.lit(True) for c in (step, entity))
    return F.struct(
        by.alias("by"), key.alias("key"), symbol.alias("symbol"), name.alias("name"), is_step.alias("is_step"), (none if step is None else step).alias("step"),
        is_entity.alias("is_entity"), (none if entity is None else entity).alias("entity"),
    )


def prove(findings: DataFrame, proofs: DataFrame, entities: DataFrame, nodes: DataFrame, context: Context) -> DataFrame:
    """finding_id, verdict (proved or rejected), code, bad (the evidence whose own proof fails).

    findings: finding_id, kind (definition, graph, semantic), relationship, path_node_ids, path_names (empty for a direct
    assertion), source_ and target_ node_id, symbol_id, name (null where nothing is claimed), entity_id, entity_name,
    chunk_id. A finding whose evidence fails gets the code of its first bad proof. Then:
    * definition: entity_id is among the evidence as a symbol or node, and is the claimed node's; else claim_provenance
      or canonical_identity.
    * graph: all relationships among the evidence are resolved and of the claimed kind, one for a direct assertion, for a
      path one from each node to the next; else claim_provenance. Every end and name is that of the stored node; else
      canonical_identity.
    * semantic: chunk_id is among the evidence as a chunk; else claim_provenance.
    Other kinds are unsupported_finding. A finding without evidence is rejected as its kind asks. Ids of findings are unique.
    """
    checked = proof_codes(proofs, entities, context)
    row = F.struct("position", "evidence_id", "kind", "source", "target", F.col("stored_relationship").alias("relationship"), "state", "code")
    folded = checked.groupBy("finding_id").agg(F.array_sort(F.collect_list(row)).alias("_proofs"))  # a finding's own evidence
    rows = findings.join(folded, "finding_id", "left")
    held = F.coalesce(F.col("_proofs"), F.array().cast(folded.schema["_proofs"].dataType))
    rows = rows.withColumn("_proofs", held).withColumns({"_edges": F.filter("_proofs", lambda p: p["kind"] == "relationship"), "_failed": F.filter("_proofs", lambda p: p["code"].isNotNull())})
    rows = rows.withColumns({"_source": F.get("_edges", F.lit(0))["source"], "_target": F.get("_edges", F.size("_edges") - 1)["target"]})
    has = lambda column, *kinds: F.exists("_proofs", lambda p: (p["evidence_id"] == F.col(column)) & p["kind"].isin(*kinds))
    is_definition, is_graph, chain = F.col("kind") == "definition", F.col("kind") == "graph", F.col("path_node_ids")
    is_path = F.coalesce(F.size(chain) > 0, F.lit(False))
    unfit = (F.size("_edges") == 0) | F.exists("_edges", lambda e: ~e["state"].eqNullSafe(F.lit("resolved")) | ~e["relationship"].eqNullSafe(F.col("relationship")))
    steps = F.zip_with(F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))), F.slice(chain, 2, F.greatest(F.size(chain), F.lit(1))), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    walked = F.transform("_edges", lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target")))
    other_end = lambda side: F.col(f"_{side}").isNull() | (F.col(f"{side}_node_id").isNotNull() & ~F.col(f"{side}_node_id").eqNullSafe(F.col(f"_{side}")))
    # what can be told without the stored nodes; what they tell comes after it for every kind, and has one code
    code = F.coalesce(
        F.get("_failed", F.lit(0))["code"],
        _first(
            (is_definition & ~F.coalesce(has("entity_id", "symbol", "node"), F.lit(False)), "claim_provenance"),
            (is_definition & F.coalesce("target_node_id", "target_symbol_id").isNull(), "canonical_identity"),
            (is_graph & unfit, "claim_provenance"),
            (is_graph & is_path & ((F.size("_edges") != F.size(chain) - 1) | ~walked.eqNullSafe(steps)), "claim_provenance"),
            (is_graph & ~is_path & (F.size("_edges") != 1), "claim_provenance"),
            (is_graph & is_path & (~F.size("path_names").eqNullSafe(F.size(chain)) | F.exists(chain, lambda n: n.isNull())), "canonical_identity"),
            (is_graph & (other_end("source") | other_end("target")), "canonical_identity"),
            ((F.col("kind") == "semantic") & ~F.coalesce(has("chunk_id", "chunk"), F.lit(False)), "claim_provenance"),
            (~F.coalesce(F.col("kind").isin("definition", "graph", "semantic"), F.lit(False)), "unsupported_finding"),
        ),
    )
    # the first step of a path is the source of its first edge by now, the last one the target of its last
    own = F.lit("id")
    at_end = lambda i, c: F.when(i == 0, F.col(f"source_{c}")).when(i == F.size(chain) - 1, F.col(f"target_{c}"))
    path = F.transform(chain, lambda n, i: _claim(own, n, at_end(i, "symbol_id"), at_end(i, "name"), step=F.get("path_names", i)))
    direct = F.array(*(_claim(own, F.col(f"_{side}"), F.col(f"{side}_symbol_id"), F.col(f"{side}_name")) for side in ("source", "target")))
    by = F.when(F.col("target_node_id").isNotNull(), "id").otherwise("symbol")
    definition = F.array(_claim(by, F.coalesce("target_node_id", "target_symbol_id"), F.col("target_symbol_id"), F.col("entity_name"), entity=F.col("entity_id")))
    claims = F.when(F.col("_code").isNotNull(), None).when(is_graph & is_path, path).when(is_graph, direct).when(is_definition, definition)
    rows = rows.withColumn("_code", code).select("finding_id", "_code", F.transform("_failed", lambda p: p["evidence_id"]).alias("_bad"), claims.alias("_claims"))
    # a row for each claim, of which the first one bears the code; a finding without claims meets no node
    said = rows.select("finding_id", "_code", "_bad", F.posexplode_outer("_claims").alias("_at", "c"))
    first = F.coalesce("_at", F.lit(0)) == 0
    said = said.select("finding_id", F.when(first, F.col("_code")).alias("code"), F.when(first, F.col("_bad")).alias("bad"), "c", F.coalesce("c.by", F.lit("")).alias("by"), F.coalesce("c.key", "finding_id").alias("key"))
    met, n = said.join(_known(nodes), ["by", "key"], "left"), F.col("node")
    differs = lambda claim, stored: F.col(claim).isNotNull() & ~F.col(claim).eqNullSafe(stored)
    wrong = n.isNull() | differs("c.symbol", n["symbol_id"]) | differs("c.name", n["label"])
    wrong = wrong | (F.col("c.is_step") & ~F.col("c.step").eqNullSafe(F.coalesce(n["label"], F.lit("")))) | (F.col("c.is_entity") & ~F.col("c.entity").eqNullSafe(F.coalesce(n["symbol_id"], n["id"])))
    met = met.select("finding_id", "code", "bad", (F.col("c").isNotNull() & wrong).alias("wrong"))
    out = met.groupBy("finding_id").agg(F.first("code", ignorenulls=True).alias("code"), F.first("bad", ignorenulls=True).alias("bad"), F.max("wrong").alias("wrong"))
    code = F.coalesce("code", F.when(F.col("wrong"), "canonical_identity"))
    return out.select("finding_id", F.when(code.isNull(), "proved").otherwise("rejected").alias("verdict"), code.alias("code"), "bad")


def preview(answers: DataFrame, items: DataFrame, verdicts: DataFrame, bad: DataFrame, context: Context) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved answers proved again: (answers with status, requirements with state, items that stay).

    answers: answer_id, repository_id, snapshot_id; items: answer_id, requirement_id, item_id, finding_id, evidence_ids
    (what the item cites). An answer of another repository is unauthorized, of another generation stale: it shows no item.
    An item goes if its finding is rejected or unknown, or if it cites evidence that fails (`bad`: answer_id, evidence_id). A
    requirement that loses an item is partially_satisfied, or error if it loses all; an answer then is partial or error.
    """
    scope = F.when(~F.col("repository_id").eqNullSafe(F.lit(context.repository_id)), "unauthorized").when(~F.col("snapshot_id").eqNullSafe(F.lit(context.snapshot_id)), "stale")
    scoped = answers.withColumn("_scope", scope)
    failing = bad.groupBy("answer_id").agg(F.collect_set("evidence_id").alias("_failing"))  # an answer's own evidence
    open_ = scoped.where("_scope IS NULL").select("answer_id").distinct().join(failing, "answer_id", "left")
    found = items.join(verdicts.select("finding_id", "verdict"), "finding_id", "left").join(open_, "answer_id")
    cites = F.coalesce(F.arrays_overlap("evidence_ids", "_failing"), F.lit(False))
    found = found.withColumn("_stays", F.col("verdict").eqNullSafe(F.lit("proved")) & ~cites)
    counted = found.groupBy("answer_id", "requirement_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("_stays").alias("left"))
    state = F.when(F.col("left") == F.col("items"), "unchanged").when(F.col("left") > 0, "partially_satisfied").otherwise("error")
    requirements = counted.select("answer_id", "requirement_id", state.alias("state"), "left")
    whole = counted.groupBy("answer_id").agg(F.sum("items").alias("items"), F.sum("left").alias("left"))
    status = F.coalesce("_scope", F.when(F.col("left") < F.col("items"), F.when(F.col("left") > 0, "partial").otherwise("error")), F.lit("verified"))
    return scoped.join(whole, "answer_id", "left").select("answer_id", status.alias("status")), requirements, found.where("_stays").select(items.columns)
