"""Graphs of a dataset: imports and named shapes graphs."""

import pytest

from shapewright.api import Dataset, results

PREFIX = "@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . "
GRAPHS = {
    None: "<http://x/data> owl:imports <http://x/more> ; sh:shapesGraph <http://x/shapes> . :a a :T ; :p 1 . _:b a :T ; :p 1 , 2 .",
    "http://x/more": "<http://x/more> owl:imports <http://x/more> . _:b a :T ; :p 3 . :c a :T ; :p 1 , 2 .",
    "http://x/shapes": "<http://x/shapes> owl:imports <http://x/part> . :s a sh:Shape ; sh:scopeClass :T ; sh:propValues ( :p :one ) .",
    "http://x/part": ":one a sh:Shape ; sh:maxCount 1 .",
    "http://x/broken": "<http://x/broken> owl:imports <http://x/absent> .",
    "http://x/alone": ":a a :T ; :p 1 , 2 .",
}


@pytest.fixture
def dataset(spark, tmp_path):
    locations = {}
    for n, (name, text) in enumerate(GRAPHS.items()):
        path = tmp_path / f"{n}.ttl"
        path.write_text(PREFIX + text)
        locations[name] = str(path)
    return Dataset(spark, locations)


def test_imports_and_shapes_graphs(dataset):
    # the two graphs' _:b are two nodes, of which only the first has two values; a cycle ends
    found = {r["this"] for r in results(dataset.validate()).collect()}
    assert "<http://x/c>" in found and "<http://x/a>" not in found
    assert len(found) == 2 and sum(n.startswith("_:") for n in found) == 1


def test_graphs_that_name_nothing_or_what_is_not_there(dataset):
    assert dataset.shapes("http://x/alone") == []
    for name in ("http://x/broken", "http://x/unknown"):
        with pytest.raises(ValueError, match="no graph"):
            dataset.data(name)
