"""Command line: ``python -m docloom JOB ...``; each job is a function of :mod:`docloom.plans.pipelines`."""

from __future__ import annotations

import argparse

from docloom.plans import pipelines
from docloom.session import local_session


def parser() -> argparse.ArgumentParser:
    """The jobs and their options."""
    top = argparse.ArgumentParser(prog="docloom")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, about: str, *places: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=about)
        for place in places:
            sub.add_argument(place)
        return sub

    job("curate", "curation sheet of a folder", "texts", "vocabulary", "output")
    mined = job("phrases", "mined phrases and suggested rules", "texts", "output")
    mined.add_argument("--min-count", type=int, default=10)
    mined.add_argument("--threshold", type=float, default=20.0)
    split = job("split", "passages a table does not hold yet", "texts", "output")
    split.add_argument("--length", type=int, default=1)
    split.add_argument("--tokens", type=int, default=5)
    fit = job("train", "model of a folder", "texts", "vocabulary", "model")
    fit.add_argument("--epochs", type=int, default=5)
    fit.add_argument("--dims", type=int, default=300)
    fit.add_argument("--window", type=int, default=10)
    group = job("cluster", "files of a folder in groups", "texts", "vocabulary", "model", "output")
    group.add_argument("--sim", type=float, default=90)
    group.add_argument("--text", action="store_true", help="with the beginning of each text")
    return top


def main(arguments: list[str] | None = None, spark=None) -> None:
    """Runs one job in a session of its own, or in ``spark``."""
    a = parser().parse_args(arguments)
    spark = spark or local_session("*")
    if a.job == "curate":
        pipelines.curate_folder(spark, a.texts, a.vocabulary, a.output)
    elif a.job == "phrases":
        pipelines.phrase_folder(spark, a.texts, a.output, min_count=a.min_count, threshold=a.threshold)
    elif a.job == "split":
        pipelines.split_folder(spark, a.texts, a.output, a.length, a.tokens)
    elif a.job == "train":
        pipelines.train_folder(spark, a.texts, a.vocabulary, a.model, epochs=a.epochs, dims=a.dims, window=a.window)
    else:
        pipelines.cluster_folder(spark, a.texts, a.vocabulary, a.model, a.output, a.sim, a.text)


if __name__ == "__main__":
    main()
