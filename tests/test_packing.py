import random

import pytest

from graphquarry.operators.packing import Limits, pack

CLAIM = "answer_id string, requirement_id string, requirement_at int, position int, finding_id string, evidence_ids array<string>, items int, bytes int"
RECORD = "answer_id string, evidence_id string, bytes int, context_bytes int, requirement_ids array<string>"


def by_hand(claims, records, x):
    """One answer at a time, leaving out one thing after another."""
    groups, selected, used, out = {}, [], set(), set()
    for c in sorted(claims, key=lambda c: (c[2], c[3])):
        groups.setdefault((c[2], c[1]), []).append(c)
    counts = {}
    for n in range(max(map(len, groups.values()), default=0)):
        for key in sorted(groups):
            if n < len(groups[key]):
                c = groups[key][n]
                why = "findings_per_requirement" if counts.get(c[1], 0) >= x.findings else "relationship_detail" if c[6] > x.items else "finding_size" if c[7] > x.finding_bytes else "evidence_records" if len(used | set(c[5])) > x.records else None
                if why:
                    out.add((c[1], c[4], why))
                else:
                    selected.append(c)
                    used |= set(c[5])
                    counts[c[1]] = counts.get(c[1], 0) + 1
    selected.sort(key=lambda c: c[3])
    kept_claims = list(selected)
    by = {r[1]: r for r in records}
    spare = [k for k in sorted(by) if k not in used and by[k][4]]
    room = max(0, x.records - len(used))
    extra = spare[:room]
    out |= {(q, k, "evidence_records") for k in spare[room:] for q in by[k][4]}
    users = lambda k: set(by[k][4]) | {c[1] for c in kept_claims if k in c[5]}
    contexts, total = [], 0
    for k in sorted([*(k for k in used if k in by), *extra]):
        size = by[k][3]
        if size > 0 and total + size <= x.context_bytes:
            contexts.append(k)
            total += size
        elif size > 0:
            out |= {(q, k, "source_context") for q in users(k)}
    while sum(c[7] for c in selected) + sum(by[k][2] for k in used if k in by) + sum(by[k][2] for k in extra) + sum(by[k][3] for k in contexts) > x.package_bytes:
        if contexts:
            k = contexts.pop()
            out |= {(q, k, "serialized_size_context") for q in users(k)}
        elif extra:
            k = extra.pop()
            out |= {(q, k, "serialized_size") for q in by[k][4]}
        elif selected:
            c = selected.pop()
            out.add((c[1], c[4], "serialized_size"))
            used = {k for c in selected for k in c[5]}
        else:
            break
    return {c[4] for c in selected}, {(k, k in contexts) for k in [*used, *extra]}, out


@pytest.mark.parametrize("x", [Limits(), Limits(6, 90, 2, 5, 60, 10_000), Limits(9, 200, 3, 9, 90, 260), Limits(20, 1000, 9, 9, 99, 150), Limits(3, 0, 1, 9, 99, 20)])
def test_packages_equal_a_plain_loop(spark, x):
    r = random.Random(x.records)
    claims, records = [], []
    for a in range(12):
        keys = [f"e{k:02}" for k in range(r.randint(0, 14))]
        records += [(f"a{a}", k, r.randint(1, 40), r.choice([0, 0, 10, 30, 50]), sorted({r.choice("pqr") for _ in range(r.randint(0, 2))})) for k in keys]
        for p in range(r.randint(0, 12)):
            q = r.randrange(3)
            claims.append((f"a{a}", "pqr"[q], q, p, f"f{a}-{p}", sorted(set(r.sample(keys, min(len(keys), r.randint(0, 3))) + (["lost"] if r.random() < 0.1 else []))), r.randint(0, 8), r.randint(5, 80)))
    out = pack(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(records, RECORD), x)
    got = {name: out[name].collect() for name in out}
    asked = {(c[0], c[1]) for c in claims} | {(a, q) for a, _, _, _, qs in records for q in qs}
    states = {}
    for a in {f"a{k}" for k in range(12)}:
        findings, evidence, omitted = by_hand([c for c in claims if c[0] == a], [e for e in records if e[0] == a], x)
        assert {g["finding_id"] for g in got["findings"] if g["answer_id"] == a} == findings, a
        assert {(g["evidence_id"], g["context"]) for g in got["evidence"] if g["answer_id"] == a} == evidence, a
        assert {(g["requirement_id"], g["what"], g["reason"]) for g in got["omissions"] if g["answer_id"] == a} == omitted, a
        states |= {(a, q): "partially_satisfied" if any(o[0] == q for o in omitted) else "satisfied" for b, q in asked if b == a}
    assert {(g["answer_id"], g["requirement_id"]): g["state"] for g in got["coverage"]} == states


def test_no_answers(spark):
    out = pack(spark.createDataFrame([], CLAIM), spark.createDataFrame([], RECORD))
    assert all(df.count() == 0 for df in out.values())
