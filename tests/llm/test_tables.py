"""Every operator on tables with null columns, other columns of clashing names, repeated rows and no rows."""

import pytest

from pageframe.llm import language, leakage, residue, scan_repair, shape, tokenizer, truncation, unify

EXTRA = ("record_id", "origin", "seen", "raw", "altered", "n", "count", "shape", "votes", "posterior", "kind", "evidence", "ids", "word", "term", "inside", "sizes", "ends", "chance", "truth", "repaired", "unified", "places", "seeds", "words")
PROSE = "The court accepts that the claim was settled before the hearing. The witness recalled that it was discussed twice"
START = shape.ShapeModel()


def _words(df):
    return scan_repair.fit_words(df, "text")


def _model(df):
    return language.fit_languages(df, "lang", "text")


def _leaks(df):
    items = df.sparkSession.createDataFrame([(1, PROSE, "x"), (1, PROSE, "x"), (2, None, None)], "item_id bigint, text string, doc_id string")
    return leakage.find_leaks(df, items)


OPERATORS = {
    "truncated_texts": lambda df: truncation.truncated_texts(df, "id", "source", "text", START),
    "hidden_limits": lambda df: truncation.hidden_limits(df, "source", "text"),
    "length_counts": lambda df: truncation.length_counts(df, "source", "text"),
    "line_defects": lambda df: scan_repair.line_defects(df, "id", "text", _words(df)),
    "repair_pages": lambda df: scan_repair.repair_pages(df, "id", "text", _words(df)),
    "classify_shapes": lambda df: shape.classify_shapes(df, "id", "text"),
    "lookalike_pairs": lambda df: unify.lookalike_pairs(df, "id", "text"),
    "unify_column": lambda df: unify.unify_column(df, "id", "text"),
    "label_problems": lambda df: language.label_problems(df, "id", "lang", "text", _model(df), START),
    "page_passages": lambda df: language.page_passages(df, "id", "text", _model(df)),
    "encode_corpus": lambda df: tokenizer.encode_corpus(df, "id", "text"),
    "find_leaks": _leaks,
    "find_residue": lambda df: residue.find_residue(df, "id", "text"),
}
#: Operators that give every row; the others give what they find once for each id.
BY_ROW = {"repair_pages", "unify_column", "page_passages", "encode_corpus", "length_counts", "hidden_limits"}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_nulls_and_repeats(texts, name):
    ddl = "id bigint, text string, source string, lang string, " + ", ".join(f"{c} string" for c in EXTRA)
    row = lambda i, text, source="s", lang="en": (i, text, source, lang, *EXTRA)
    rows = [row(1, PROSE), row(1, PROSE), row(2, None), row(3, ""), row(4, " \n\u200b"), row(5, PROSE + " by the\ncou", None, None), row(6, "x" * 300_000), row(7, "\ud7ff\U0001f600 \x00"), (8, PROSE, *[None] * (len(EXTRA) + 2)), row(None, PROSE)]
    found = OPERATORS[name](texts(rows, ddl)).collect()
    if name in ("encode_corpus", "repair_pages", "unify_column"):
        assert len(found) == len(rows)
    elif name not in BY_ROW:
        assert len(found) == len(set(map(str, found)))
    plain = OPERATORS[name](texts([r[:4] for r in rows], "id bigint, text string, source string, lang string")).collect()
    assert sorted(map(str, plain)) == sorted(map(str, found))
    assert OPERATORS[name](texts([], ddl)).count() == 0
