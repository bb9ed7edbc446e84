import re
from functools import cache
from pathlib import Path

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@cache
def used_names():
    """All names that the operators' code gives to columns: what it calls alias, toDF, withColumn and the like with, and its schemas."""
    found = set()
    for path in (Path(__file__).parents[2] / "pointloom/llm").glob("*.py"):
        code = path.read_text()
        found |= set(re.findall(r"""["']([A-Za-z_]\w*)["']""", code))
        for schema in re.findall(r"""["']([a-z_]+ (?:long|int|string|double|binary|boolean)[^"']*)["']""", code):
            found |= {part.split()[0] for part in schema.split(", ") if part.split()}
    return sorted({n.lower() for n in found} - {"_metadata"})


@pytest.fixture
def make_docs(spark):
    """Documents of texts, or of (doc_id, text) pairs."""

    def make(*texts, extra=False):
        rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        if not extra:
            return spark.createDataFrame(rows, DOCS)
        names = [n for n in used_names() if n not in ("doc_id", "text", "lang", "source", "n_chars")]
        return spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], DOCS + "".join(f", `{n}` string" for n in names))

    return make
