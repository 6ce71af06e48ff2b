import pytest

from pageframe.llm.language import common_words, fit_languages, label_code, label_problems, page_passages
from pageframe.llm.shape import ShapeModel

EN = "The respondent replied that the court had never been asked about the notice period. The witness recalled that the lease was discussed twice. "
DE = "Das Gericht nimmt an, dass die Kündigungsfrist vor dem Termin geklärt war. Der Beklagte erwiderte, er sei dazu niemals gefragt worden. "
FR = "La cour admet que le bail du hangar avait été fixé avant le mois de mai. Rien dans le dossier ne permet d'appuyer la demande. "
DDL = "id bigint, lang string, text string"


@pytest.fixture(scope="module")
def pages(spark):
    train = [(100 + k, label, t) for k in range(40) for label, t in (("en-GB", EN), ("ger", DE), ("French", FR))]
    return spark.createDataFrame(train, DDL)


@pytest.fixture(scope="module")
def model(pages):
    return fit_languages(pages, "lang", "text")


def test_labels():
    assert [label_code(x) for x in ("EN", "en-GB", "rum", "Deutsch", " fra ", "und", "", None, "n/a", "unknown")] == ["en", "en", "ro", "de", "fr", None, None, None, None, None]


def test_problems(spark, model):
    rows = [(1, "en", EN), (2, "de", EN), (3, None, DE), (4, "fr", FR + DE), (5, "und", FR), (5, "und", FR), (6, "en", None), (7, "en", " "), (8, None, "- The fee\n- The map\n- The tank\n- The lease"), (9, "english", EN * 2000)]
    found = label_problems(spark.createDataFrame(rows, DDL), "id", "lang", "text", model, ShapeModel()).collect()
    assert sorted((r["record_id"], r["lang"], r["problem"]) for r in found) == [(2, "en", "wrong"), (3, "de", "missing"), (4, "de", "mixed"), (4, "fr", "mixed"), (5, "fr", "missing")]
    assert all(0.5 < r["confidence"] <= 1 for r in found)
    assert label_problems(spark.createDataFrame([], DDL), "id", "lang", "text", model, ShapeModel()).count() == 0


def test_unseen_words_back_off_to_ngrams(model):
    scores = model.score("Kündigungsgericht")
    assert max(range(6), key=scores.__getitem__) == 2


def test_held_out_accuracy(spark, model):
    held = [("en", "The court accepts that the witness was asked about the lease."), ("de", "Das Gericht war niemals vor dem Termin gefragt worden."), ("fr", "La demande du hangar avait été fixé dans le dossier.")]
    assert [max(model.languages(t), key=model.languages(t).get) for _, t in held] == [x for x, _ in held]


def test_passages_cover_the_sentences(spark, model):
    rows = spark.createDataFrame([(1, "fr", FR + DE), (2, None, None)], DDL)
    got = page_passages(rows, "id", "text", model).orderBy("start").collect()
    assert [(r["lang"], (FR + DE)[r["start"] : r["end"]][:3]) for r in got] == [("fr", "La "), ("de", "Das")]


def test_common_words(texts):
    rows = [(k, f"The court of the town heard the case number{k} and word{k} again", "en" if k % 2 else "English") for k in range(300)] + [(900, "rare words of nobody", None), (901, None, "en")]
    assert common_words(texts(rows, "id bigint, text string, lang string"), "lang", "text") == frozenset("the court of town heard case number and word again".split())
    assert common_words(texts([], "id bigint, text string, lang string"), "lang", "text") == frozenset()
