"""Every query outside the corpus operators, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adaptation, crossword, discriminative, frontend, further, models, normalisation, pronounce, questions, selection, sequences, texts, training, validation

ALL = {**models.QUERIES, **sequences.QUERIES, **texts.QUERIES, **validation.QUERIES, **further.QUERIES, **training.QUERIES, **questions.QUERIES, **frontend.QUERIES, **crossword.QUERIES, **adaptation.QUERIES, **selection.QUERIES, **discriminative.QUERIES, **pronounce.QUERIES, **normalisation.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
