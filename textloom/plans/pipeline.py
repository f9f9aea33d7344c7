"""The cleaning pipeline: an ordered list of steps, each a DataFrame transformation of one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.text import settled
from ..operators import cleaning, optimizing
from ..operators.metrics import measured
from ..operators.validation import result_error
from .config import Config

Step = Callable[[DataFrame, str], DataFrame]


def step_function(name: str, config: Config, synonyms: dict[str, list[str]] | None = None) -> Step:
    if name == "domain_terms":
        terms = optimizing.DomainTerms(config.get("optimization.domain_abbreviations", []), config.get("optimization.custom_dictionary", {}))
        return terms.apply
    if name == "simplify_vocabulary":
        words = optimizing.Vocabulary(synonyms or {}, config.get("optimization.min_word_length", 4))
        return words.apply
    if name == "optimize_line_length":
        width = int(config.get("optimization.max_line_length", 0))
        return lambda df, c: optimizing.optimize_line_length(df, c, width)
    return getattr(cleaning, name, None) or getattr(optimizing, name)


class Pipeline:
    """Steps in order. ``register`` adds one of your own."""

    def __init__(self, steps: list[tuple[str, Step]]):
        self.steps = steps

    @classmethod
    def from_config(cls, config: Config | None = None, synonyms: dict[str, list[str]] | None = None) -> Pipeline:
        config = config or Config()
        return cls([(n, step_function(n, config, synonyms)) for n in config.steps()])

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def register(self, name: str, step: Step, before: str | None = None) -> Pipeline:
        at = self.names.index(before) if before else len(self.steps)
        return Pipeline([*self.steps[:at], (name, step), *self.steps[at:]])

    def apply(self, df: DataFrame, column: str, out: str | None = None) -> DataFrame:
        """The column processed, in place or as ``out``. Neighbouring Python steps cross to Python once."""
        c = out or column
        if c != column:
            df = df.withColumn(c, df[column])
        i = 0
        while i < len(self.steps):
            name, step = self.steps[i]
            if name == "merge_short_paragraphs" and self.names[i + 1 : i + 2] == ["normalize_unicode"]:
                name, step, i = "", cleaning.merge_and_normalize, i + 1
            df = step(df, c)
            i += 1
        return settled(df, c)


def processed(df: DataFrame, column: str, pipeline: Pipeline | None = None) -> DataFrame:
    """The lifecycle of documents: processed text, metrics, success and error of each row."""
    p = pipeline or Pipeline.from_config()
    df = measured(p.apply(df, column, "processed"), column, "processed")
    return df.withColumn("error", result_error(df[column], df["processed"])).selectExpr("*", "error IS NULL AS success")
