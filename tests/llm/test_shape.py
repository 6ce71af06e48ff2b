import random
from collections import Counter

import numpy as np

from pageframe.llm.shape import ABSTAIN, MISSING, NAMES, ShapeModel, classify_shapes, shape_of, statistics, votes

PROSE = "The witness recalled that the lease was discussed twice, once in 2015.\nThe court accepts that the claim was settled before the hearing took place."
LIST = "Findings of the court:\n- The storage tank\n- The notice period, 4 May 2012\n- The licence fee\n- The survey map"
TABLE = "No\tItem\tDate\tAmount\n1\tLicence fee\t10.08.2013\t158.30\n2\tSurvey map\t-\t11.20\n3\tStorage tank\t01.01.2011\t9.00"
JUNK = "#~*¶ §§ <<~ ∎∎\n¤¤ §~ #* ¶¶ ~~<\n=~\\ §> §> #"


def test_shapes():
    model = ShapeModel()
    assert [shape_of(t, model) for t in (PROSE, LIST, TABLE, JUNK)] == ["prose", "list", "table", "junk"]
    assert shape_of(None, model) is None and shape_of(" \n ", model) is None


def test_numbered_paragraphs_are_prose():
    assert shape_of("\n".join(f"{k}. {PROSE}" for k in range(3, 9)), ShapeModel()) == "prose"


def test_fit_learns_that_a_function_is_wrong():
    """One function of twelve votes at random, one always for the wrong shape; the fit tells them from the right ones."""
    rnd = random.Random(4)
    wrong, blind = NAMES.index("symbols"), NAMES.index("line_ends")
    counts, truth = Counter(), []
    for _ in range(4000):
        y = rnd.choices(range(4), (70, 15, 10, 5))[0]
        v = [y if rnd.random() < 0.8 else ABSTAIN for _ in NAMES]
        v[wrong], v[blind] = (y + 1) % 4, rnd.randrange(4)
        v[-1] = MISSING
        counts[tuple(v)] += 1
        truth.append((tuple(v), y))
    model = ShapeModel().fit(counts)
    right = model.accuracies()
    assert right["symbols"] < 0.1 and right["line_ends"] < 0.6 and min(right[n] for n in NAMES if n not in ("symbols", "line_ends", "stored_flags")) > 0.9
    assert np.abs(model.prior - (0.7, 0.15, 0.1, 0.05)).max() < 0.03
    assert sum(int(model.posterior(v).argmax()) == y for v, y in truth) > 0.99 * len(truth)


def test_stored_quality_votes():
    s = statistics(JUNK)
    assert votes(s)[-2:] == (MISSING, MISSING) and votes(s, 0.3, ["symbol-noise"])[-2:] == (3, 3) and votes(s, 0.9, [None])[-2:] == (ABSTAIN, ABSTAIN)
    assert votes(s, float("nan"), [])[-2:] == (MISSING, ABSTAIN) and votes(s, 93.0)[-2:] == (MISSING, MISSING)
    model = ShapeModel()
    assert model.posterior((ABSTAIN,) * 10 + (MISSING, 3)).argmax() == 3


def test_table(texts):
    rows = [(1, PROSE), (2, LIST), (2, LIST), (3, TABLE), (4, JUNK), (5, None), (6, ""), (7, PROSE * 3000)]
    got = {r["record_id"]: r["shape"] for r in classify_shapes(texts(rows), "id", "text").collect()}
    assert got == {1: "prose", 2: "list", 3: "table", 4: "junk", 7: "prose"}
    assert classify_shapes(texts([]), "id", "text").count() == 0
    stored = texts([(1, PROSE, 0.9, ["dictionary-miss"]), (2, JUNK, 0.2, ["symbol-noise", None]), (3, LIST, None, None), (4, TABLE, float("nan"), [])], "id bigint, text string, q double, f array<string>")
    got = {r["record_id"]: r["shape"] for r in classify_shapes(stored, "id", "text", "q", "f").collect()}
    assert got == {1: "prose", 2: "junk", 3: "list", 4: "table"}
