"""Test sets by name: their files below a root folder of the caller."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prosemeter.sources.readers import parallel


@dataclass(frozen=True)
class TestSet:
    """File patterns; `{i}` runs over the references from `first`."""

    source: str
    reference: str
    n_references: int
    first: int = 0

    def files(self, root: str) -> tuple[str, list[str]]:
        return f"{root}/{self.source}", [f"{root}/{self.reference.format(i=i)}" for i in range(self.first, self.first + self.n_references)]


#: File names of the public corpora as they are distributed.
TEST_SETS = {
    "asset_test": TestSet("asset/asset.test.orig", "asset/asset.test.simp.{i}", 10),
    "asset_valid": TestSet("asset/asset.valid.orig", "asset/asset.valid.simp.{i}", 10),
    "turkcorpus_test": TestSet("turkcorpus/test.truecase.detok.orig", "turkcorpus/test.truecase.detok.simp.{i}", 8),
    "turkcorpus_valid": TestSet("turkcorpus/tune.truecase.detok.orig", "turkcorpus/tune.truecase.detok.simp.{i}", 8),
    "turkcorpus_test_legacy": TestSet("turkcorpus/legacy/test.8turkers.tok.norm", "turkcorpus/legacy/test.8turkers.tok.turk.{i}", 8),
    "turkcorpus_valid_legacy": TestSet("turkcorpus/legacy/tune.8turkers.tok.norm", "turkcorpus/legacy/tune.8turkers.tok.turk.{i}", 8),
    "pwkp_test": TestSet("pwkp/pwkp.test.orig", "pwkp/pwkp.test.simp", 1),
    "pwkp_valid": TestSet("pwkp/pwkp.valid.orig", "pwkp/pwkp.valid.simp", 1),
    "hsplit_test": TestSet("hsplit/hsplit.tok.src", "hsplit/hsplit.tok.{i}", 4, 1),
    "wikisplit_test": TestSet("wikisplit/wikisplit.test.untok.orig", "wikisplit/wikisplit.test.untok.split", 1),
    "wikisplit_valid": TestSet("wikisplit/wikisplit.valid.untok.orig", "wikisplit/wikisplit.valid.untok.split", 1),
    "googlecomp_test": TestSet("googlecomp/googlecomp.test.orig", "googlecomp/googlecomp.test.comp", 1),
    "googlecomp_valid": TestSet("googlecomp/googlecomp.valid.orig", "googlecomp/googlecomp.valid.comp", 1),
    "qats_test": TestSet("qats/qats.test.orig", "qats/qats.test.simp", 1),
}
ALIASES = {"turk": "turkcorpus_test", "turk_valid": "turkcorpus_valid"}
CUSTOM = "custom"


def test_set(name: str) -> TestSet:
    if name in ALIASES:
        warnings.warn(f"{name} is now called {ALIASES[name]}", DeprecationWarning, stacklevel=2)
        name = ALIASES[name]
    if name not in TEST_SETS:
        raise ValueError(f"no test set {name!r}; there are {', '.join(TEST_SETS)} and {CUSTOM}")
    return TEST_SETS[name]


def load(spark: SparkSession, name: str, root: str, outputs: dict[str, str], source: str | None = None, references: list[str] | None = None) -> DataFrame:
    """Samples of a test set, or of the caller's own files under the name `custom`."""
    if name == CUSTOM:
        if not source or not references:
            raise ValueError("custom needs a source file and reference files")
        return parallel(spark, source, references, outputs)
    src, refs = test_set(name).files(root)
    return parallel(spark, src, refs, outputs)
