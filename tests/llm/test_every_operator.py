"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from tallyweir.llm import decontaminate, langid, media, ngram_join, pieces, pii, quality, repeats, toxicity
from tallyweir.llm.queries import piece_model

OPERATORS = {
    "media": lambda d, l: media.digests(d),
    "langid": lambda d, l: langid.predictions(d),
    "repeats": lambda d, l: repeats.remove_repeats(d),
    "ngram_join": lambda d, l: ngram_join.near_duplicates(d),
    "pieces": lambda d, l: pieces.digests(d, piece_model()),
    "pii": lambda d, l: pii.findings(d),
    "toxicity": lambda d, l: toxicity.predictions(d, l),
    "quality": lambda d, l: quality.predictions(d, l),
}
#: What a row's result may depend on besides its text.
OWN = {"doc_id", "held_out", "component_id", "n_removed", "n_spans", "kept_sha256"}


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(name, edge, clashing, empty, labels, no_labels, edge_rows):
    f = OPERATORS[name]
    got = rows(f(edge, labels))
    assert len(got) == len(edge_rows)
    assert [dict(r)["doc_id"] for r in sorted(got, key=lambda r: (dict(r)["doc_id"] is not None, dict(r)["doc_id"] or 0))] == sorted((r[0] for r in edge_rows), key=lambda i: (i is not None, i or 0))
    assert rows(f(clashing, labels)) == got
    assert rows(f(empty, labels)) == [] and f(empty, labels).columns == f(edge, labels).columns
    assert len(rows(f(edge, no_labels))) == len(edge_rows)
    # equal texts, equal values
    texts = {r[0]: r[1] or "" for r in edge_rows if r[0] is not None}
    seen = {}
    for r in map(dict, got):
        if r["doc_id"] is not None:
            value = {k: v for k, v in r.items() if k not in OWN}
            assert seen.setdefault(texts[r["doc_id"]], value) == value


def test_decontaminate_edges(edge, clashing, empty, benchmark):
    got = rows(decontaminate.leaks(edge, benchmark))
    assert {(dict(r)["doc_id"], dict(r)["item_id"]) for r in got} == {(i, 0) for i in (3, 4, 5, 13, None)}
    assert rows(decontaminate.leaks(clashing.drop("item"), benchmark)) == got
    assert rows(decontaminate.leaks(edge, benchmark, block_bytes=50)) == got
    assert rows(decontaminate.leaks(empty, benchmark)) == []
    assert rows(decontaminate.leaks(edge, benchmark.limit(0))) == []
    assert sorted(decontaminate.clean(clashing, benchmark).columns) == sorted(clashing.columns)
    assert decontaminate.clean(edge, benchmark).count() == edge.count() - 6
