"""Registered queries of the training-data operators: opN_<name> on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .common import read_table
from .op1_ordinal import op1_ordinal
from .op2_oddsketch import op2_oddsketch
from .op3_warczst import op3_warczst
from .op4_bwt import op4_bwt
from .op5_tokenfile import op5_tokenfile
from .op6_bpe import op6_bpe
from .op7_rules import SQL as OP7_SQL, op7_rules
from .op8_poisson import SQL as OP8_SQL, op8_poisson
from .op9_automaton import SQL as OP9_SQL, op9_automaton
from .op10_maxscore import SQL as OP10_SQL, op10_maxscore
from .op11_licenses import SQL as OP11_SQL, op11_licenses
from .op12_phrases import SQL as OP12_SQL, op12_phrases
from .op13_fim import SQL as OP13_SQL, op13_fim

#: Query to (its tables, its operator).
OPERATORS = {
    "op1_ordinal": ("documents labels", op1_ordinal),
    "op2_oddsketch": ("documents", op2_oddsketch),
    "op3_warczst": ("pages", op3_warczst),
    "op4_bwt": ("documents", op4_bwt),
    "op5_tokenfile": ("documents", op5_tokenfile),
    "op6_bpe": ("documents", op6_bpe),
    "op7_rules": ("documents", op7_rules),
    "op8_poisson": ("documents", op8_poisson),
    "op9_automaton": ("documents", op9_automaton),
    "op10_maxscore": ("embeddings", op10_maxscore),
    "op11_licenses": ("documents", op11_licenses),
    "op12_phrases": ("documents", op12_phrases),
    "op13_fim": ("documents", op13_fim),
}


def _query(tables: str, operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(*[read_table(spark, sf_dir, t) for t in tables.split()])
    return run


REGISTRY = {name: _query(*x) for name, x in OPERATORS.items()}
SQL = {"op7_rules": OP7_SQL, "op8_poisson": OP8_SQL, "op9_automaton": OP9_SQL, "op10_maxscore": OP10_SQL,
       "op11_licenses": OP11_SQL, "op12_phrases": OP12_SQL, "op13_fim": OP13_SQL}
