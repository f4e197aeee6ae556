"""Jobs from the command line: python -m terrascope job NAME name=value ...

    job_dept_aggregate  sales= cities= dept_stats=
    job_import_year     sales= cities= transactions= city_stats= year=
    job_reference_data  regions= departments= cities= regions_json= departments_json= communes_json= out=
    job_score_reviews   reviews= target=
    job_energy          path= target=
    job_health          path= target=
    job_recompute_stats transactions= city_stats= regions= departments= cities= sales= dept_stats=
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from .plans import jobs
from .session import build_session


def run_job(spark: SparkSession, name: str, given: dict[str, str]):
    """Run one job with its paths; what it returns."""
    if name == "job_dept_aggregate":
        return jobs.job_dept_aggregate(spark, given)
    if name == "job_import_year":
        return jobs.job_import_year(spark, given, int(given["year"]))
    if name == "job_reference_data":
        return jobs.job_reference_data(spark, given)
    if name == "job_score_reviews":
        return jobs.job_score_reviews(spark, spark.read.parquet(given["reviews"]), given["target"])
    if name in ("job_energy", "job_health"):
        return getattr(jobs, name)(spark, given["path"], given["target"])
    if name == "job_recompute_stats":
        return jobs.job_recompute_stats(spark, given, dt.datetime.now())
    raise ValueError(f"unknown job {name!r}")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="terrascope", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("command", choices=["job"])
    parser.add_argument("name")
    parser.add_argument("given", nargs="*", metavar="name=value")
    parsed = parser.parse_args(args)
    result = run_job(build_session(), parsed.name, dict(g.split("=", 1) for g in parsed.given))
    for df in result.values() if isinstance(result, dict) else [result]:
        df.show()


if __name__ == "__main__":
    main()
