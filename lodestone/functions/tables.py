"""Table functions for SQL: chunks of a text, called by lateral join."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, ShortType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_CHUNK = StructType().add("chunk_no", IntegerType()).add("content", StringType()).add("start_line", IntegerType()).add("end_line", IntegerType())
_SECTION = StructType([*_CHUNK.fields, StructField("heading", StringType())])


def _analyzed(schema: StructType, text: AnalyzeArgument, **sizes: AnalyzeArgument | None) -> AnalyzeResult:
    """The result's columns, after a look at the arguments: a text, and sizes that are positive constants."""
    if not isinstance(text.dataType, StringType):
        raise ValueError(f"the text is of type {text.dataType.simpleString()}")
    for name, given in sizes.items():
        if given is None:
            continue
        if not isinstance(given.dataType, (IntegerType, LongType, ShortType)) or not given.isConstantExpression:
            raise ValueError(f"{name} has to be a constant whole number")
        if given.value is None or given.value < (name == "most"):
            raise ValueError(f"{name} is {given.value}")
    return AnalyzeResult(schema=schema)


@udtf
class SplitChunks:
    """``split_chunks(text, most, overlap)``: chunks by length; a null text counts as empty."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(_CHUNK, text, most=most, overlap=overlap)

    def eval(self, text: str, most: int = 1500, overlap: int = 200):
        from lodestone.operators.chunking import by_length

        for n, (content, first, last) in enumerate(by_length(text or "", most, overlap)):
            yield n, content, first, last


@udtf
class SplitMarkdown:
    """``split_markdown(text, most, overlap)``: chunks by Markdown heading, then by length."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(_SECTION, text, most=most, overlap=overlap)

    def eval(self, text: str, most: int = 1500, overlap: int = 200):
        from lodestone.operators.chunking import by_heading

        for n, (content, first, last, heading) in enumerate(by_heading(text or "", most, overlap)):
            yield n, content, first, last, heading


TABLE_FUNCTIONS = {"split_chunks": SplitChunks, "split_markdown": SplitMarkdown}


def register_tables(spark: SparkSession) -> list[str]:
    """Makes the table functions known to the session; returns their names."""
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
    return list(TABLE_FUNCTIONS)
