"""Detectors by name: Python code that looks at one text, callable from SQL as a table function (LATERAL) and as a detector.

For detectors that need a model or a library; rules and lookups that expressions can state are in detect.py.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tagmask.model import CATEGORIES

#: What a table function gives for one text.
FOUND = T.StructType([T.StructField("det_seq", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("category", T.StringType())])
_known: dict[str, bool] = {}


def table_function(find: Callable[..., Iterable[tuple[str, str]]], listed: bool):
    """A table function (Arrow-batched) around `find`: of a text, or (`listed`) of a text and its dossier's list of structs (value,
    category), to (value, category) pairs. A category that the model does not know ends the query."""

    class Detector:
        @staticmethod
        def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
            if len(args) != 1 + listed or not isinstance(args[0].dataType, T.StringType):
                raise ValueError("a detector takes a text" + (" and a list of values" if listed else ""))
            return AnalyzeResult(FOUND)

        def eval(self, *args):
            text = args[0]
            if text is None:
                return
            for i, (value, category) in enumerate(find(*args)):
                if category not in CATEGORIES:
                    raise ValueError(f"no category: {category}")
                yield i, value, category

    return udtf(Detector, useArrow=True)


def register_detector(spark: SparkSession, name: str, find: Callable[..., Iterable[tuple[str, str]]], listed: bool = False) -> None:
    """Make `find` known as SQL table function `name`; see table_function."""
    spark.udtf.register(name, table_function(find, listed))
    _known[name] = listed


def detector(spark: SparkSession, name: str, values: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A registered table function as a detector of documents (see detect.py); `values` (dossier_id, value, category) is the
    table that a detector with lists answers from: dossiers without a row give nothing."""
    if name not in _known:
        raise KeyError(f"no detector is registered as {name}")

    def detect(docs: DataFrame) -> DataFrame:
        view, lists = f"docs_{uuid.uuid4().hex}", f"values_{uuid.uuid4().hex}"
        docs.select("dossier_id", "doc_id", "arrival", "text").createOrReplaceTempView(view)
        columns = "d.dossier_id, d.doc_id, d.arrival, f.det_seq, f.value, f.category"
        if not _known[name]:
            return spark.sql(f"SELECT {columns} FROM {view} d, LATERAL {name}(d.text) f")
        values.createOrReplaceTempView(lists)
        joined = f"(SELECT dossier_id, array_sort(collect_set(struct(value, category))) AS v FROM {lists} GROUP BY dossier_id)"
        return spark.sql(f"SELECT {columns} FROM {view} d JOIN {joined} l ON d.dossier_id = l.dossier_id, LATERAL {name}(d.text, l.v) f")

    return detect


def contained(text: str, values: list) -> list[tuple[str, str]]:
    """The lookup detector as Python: listed values that the text holds, in the list's order."""
    return [(v["value"], v["category"]) for v in values if v["value"] in text]
