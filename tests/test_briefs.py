"""Units taken within a budget, against a plain fold."""
import random

from evigraph.operators import briefs

SECTIONS = ["a", "b", "c", "d", "e"]


def foot(left, budget):
    groups = [f"{left[s]} {s}" for s in SECTIONS if left[s]]
    rest = sum(left[s] for s in [s for s in SECTIONS if left[s]][3:])
    return "" if not groups else f"left out to fit {budget} tokens: " + "; ".join(groups[:3] + ([f"{rest} more"] if rest else []))


def taken_plainly(units, budget):
    limit, used, ranks, stopped, halted = 4 * budget, 0, [], set(), False
    left = {s: sum(u[4] for u in units if u[1] == s) for s in SECTIONS}
    for rank, section, size, essential, count in sorted(units):
        if halted or section in stopped:
            continue
        after = left | {section: left[section] - count}
        line = foot(after, budget)
        if limit and used + size + (len(line) + 1 if line else 0) > limit:
            stopped.add(section)
            halted = essential
            continue
        used, left = used + size, after
        ranks.append(rank)
    line = foot(left, budget)
    if limit and line and used + len(line) + 1 > limit:
        line = f"left out to fit {budget} tokens: {sum(left.values())} items"
    return ranks, used, line if limit else ""


def test_units_are_taken_as_a_plain_fold_takes_them(spark):
    rng = random.Random(11)
    rows = {f"s{k}": [(r, rng.choice(SECTIONS), rng.choice([5, 20, 40, 90, 400]), rng.random() < 0.1, rng.choice([1, 1, 1, 12])) for r in range(rng.randint(1, 40))] for k in range(60)}
    rows["many"] = [(r, rng.choice("ab"), 1, False, 1) for r in range(3000)]
    frame = spark.createDataFrame([(s, *u) for s, units in rows.items() for u in units], "subject string, rank long, section string, size long, essential boolean, count long")
    for budget in (0, 15, 60, 200, 2000):
        got = {r.subject: (r.ranks, r.used, r.foot) for r in briefs.select_units(frame, budget, SECTIONS).collect()}
        for subject, units in rows.items():
            assert got[subject] == taken_plainly(units, budget), (subject, budget)


def test_no_units_no_rows(spark):
    frame = spark.createDataFrame([], "subject string, rank long, section string, size long, essential boolean, count long, text string")
    assert briefs.fitted_texts(frame, 10, SECTIONS).count() == 0


def test_all_budgets_come_from_one_gathering(spark):
    rng = random.Random(5)
    rows = {f"s{k}": [(r, rng.choice(SECTIONS), rng.choice([5, 20, 40, 90]), rng.random() < 0.3, rng.choice([1, 12])) for r in range(rng.randint(1, 30))] for k in range(30)}
    text = lambda u: f"{u[0]}".rjust(u[2] - 1, ".")
    frame = spark.createDataFrame([(s, *u, text(u)) for s, units in rows.items() for u in units], "subject string, rank long, section string, size long, essential boolean, count long, text string")
    fitted = briefs.fitted_texts(frame, [0, 15, 60], SECTIONS)
    want = {}
    for subject, units in rows.items():
        for budget in (0, 15, 60):
            ranks, _, line = taken_plainly(units, budget)
            want[subject, budget] = (len(ranks), "\n".join([text(u) for u in sorted(units) if u[0] in ranks] + [line] * bool(line)))
    assert {(r.subject, r.budget): (r.taken, r.text) for r in fitted.collect()} == want
    # One aggregate gathers a subject's units, whatever the budgets, and no unit meets its text again.
    plan = fitted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
