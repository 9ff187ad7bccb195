"""Deterministic synthetic corpus for demonstrations and tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TOPICS = {
    "cs.DB": "index join shard query storage ledger schema replica cache planner",
    "cs.CL": "parser token dialogue corpus grammar translation summary speech lexicon prompt",
    "cs.CV": "image segment depth pixel camera pose texture scene optical contour",
    "cs.RO": "robot grasp planner joint terrain drone sensor controller path gripper",
    "cs.CR": "cipher attack malware key protocol privacy audit exploit trust firewall",
    "cs.LG": "gradient kernel ensemble sampling regression loss optimizer layer embedding calibration",
}


def synthetic_papers(spark: SparkSession, n: int, start: str = "2022-01-01", end: str = "2025-12-31", skew: float = 1.5, seed: int = 42) -> DataFrame:
    """n raw paper rows over the topics in turn, dates leaning to the end by `skew`; each row depends on its id alone."""
    days = int((np.datetime64(end) - np.datetime64(start)).astype(int))

    def make(batches):
        names = list(TOPICS)
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                cat = names[int(i) % len(names)]
                terms = list(rng.choice(TOPICS[cat].split(), size=int(rng.integers(5, 9)), replace=False))
                date = np.datetime64(start) + np.timedelta64(int(rng.beta(2.0, 2.0 / skew) * days), "D")
                who = "; ".join(f"Author {int(a)}" for a in rng.integers(0, 500, int(rng.integers(1, 5))))
                title = f"On {terms[0]} and {terms[1]} for {terms[2]} systems {i}"
                text = f"We study the {terms[0]} of {terms[1]} and show that the {' and the '.join(terms[2:])} can be improved in this paper number {i}."
                rows.append((int(i), f"{str(date)[2:4]}{str(date)[5:7]}.{int(i) % 100000:05d}", 1, title, text, who, cat, cat, str(date), str(date)))
            yield pd.DataFrame(rows, columns=["row_id", "arxiv_id", "version", "title", "abstract", "authors", "categories", "primary_category", "first_submitted", "last_updated"])

    schema = "row_id long, arxiv_id string, version int, title string, abstract string, authors string, categories string, primary_category string, first_submitted string, last_updated string"
    return spark.range(n).mapInPandas(make, schema)
