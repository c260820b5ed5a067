"""A registered data source of synthetic character-counting problems, made on the executors."""

from __future__ import annotations

import random

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CountingProblems(DataSource):
    """``spark.read.format("counting_problems")`` with options rows, shortest, longest, partitions and seed.

    Each row asks how often a letter occurs in a word and has a worked response; row i depends on seed and i only.
    """

    @classmethod
    def name(cls) -> str:
        return "counting_problems"

    def schema(self) -> str:
        return "id long, prompt string, response string, split string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.rows, self.parts = int(options.get("rows", 1000)), int(options.get("partitions", 4))
        self.shortest, self.longest = int(options.get("shortest", 5)), int(options.get("longest", 20))
        self.seed = int(options.get("seed", 0))

    def partitions(self):
        step = -(-self.rows // self.parts) or 1
        return [InputPartition((a, min(a + step, self.rows))) for a in range(0, self.rows, step)]

    def read(self, partition):
        for i in range(*partition.value):
            rng = random.Random(f"{self.seed}:{i}")
            word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(self.shortest, self.longest)))
            letter = rng.choice(word)
            steps, seen = [], 0
            for c in word:
                seen += c == letter
                steps.append(f"{c} {'=' if c == letter else '!='} {letter}: {seen}")
            yield i, f"How many {letter} are there in {word}?", "\n".join([*steps, f"\\boxed{{{seen}}}"]), "test" if i % 10 == 9 else "train"
