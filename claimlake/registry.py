"""Extension points: claim generators, readers, command plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.operators import extract

Generator = Callable[[DataFrame], DataFrame]
GENERATORS: dict[str, Generator] = {}
PLUGINS = "claimlake.plugins"


def generator(name: str) -> Callable[[Generator], Generator]:
    """Registers a function from documents (doc_id, text) to candidates; a name is taken once."""

    def add(fn: Generator) -> Generator:
        if name in GENERATORS:
            raise ValueError(f"{name} is registered")
        GENERATORS[name] = fn
        return fn

    return add


def run(docs: DataFrame, enabled: list[str]) -> DataFrame:
    """Candidates of the enabled generators, in that order (``pass`` counts it); an unknown name is a KeyError."""
    parts = [GENERATORS[name](docs).withColumns({"generator": F.lit(name), "pass": F.lit(i)}) for i, name in enumerate(enabled)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


for _name, _fn in (
    ("tier0_markdown", extract.markdown_tables),
    ("tier0_statutory", extract.statute_mentions),
    ("tier0_cases", extract.case_citations),
    ("tier0_blockquotes", extract.blockquotes),
    ("tier0_headings", extract.headings),
    ("tier1_crossref", extract.cross_references),
    ("tier1_interprets", extract.case_interpretations),
):
    generator(_name)(_fn)


def plugins(group: str = PLUGINS) -> tuple[dict[str, object], dict[str, str]]:
    """Loaded plug-ins and the errors of those that did not load: one broken plug-in breaks no other."""
    good, bad = {}, {}
    for point in metadata.entry_points(group=group):
        try:
            good[point.name] = point.load()
        except Exception as error:  # whatever a plug-in raises concerns that plug-in
            bad[point.name] = f"{type(error).__name__}: {error}"
    return good, bad
