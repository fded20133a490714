"""Job aggregation: landed feed pages to ranked jobs and summaries."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from talentspark.operators import jobs as J
from talentspark.session import settle_table
from talentspark.sources.feeds import normalise
from talentspark.sources.landing import page_window


@dataclass(frozen=True)
class JobReport:
    """``matching``: scored listings, unique per source and id. ``jobs``: also unique per title
    and company, with the ranking columns still in place. Both come without the description and
    from one table, so that all summaries together score the listings once; ``scored`` has it."""

    matching: DataFrame
    jobs: DataFrame
    scored: DataFrame

    def ranked(self) -> DataFrame:
        return J.rank_jobs(self.jobs).select(*J.JOB_COLUMNS)

    def top(self, n: int = 10) -> DataFrame:
        return J.top_jobs(self.jobs, n)

    def total(self) -> DataFrame:
        return J.jobs_total(self.jobs)

    def by_source(self) -> DataFrame:
        return J.jobs_by_source(self.jobs)

    def by_score(self) -> DataFrame:
        return J.score_distribution(self.jobs)

    def matches_per_source(self) -> DataFrame:
        return J.matches_per_source(self.matching)

    def descriptions(self) -> DataFrame:
        """The text documents of ``jobs``."""
        return J.descriptions(J.title_company_dedup(J.uid_dedup(self.scored)))


def report(listings: DataFrame, skills: list[str]) -> JobReport:
    """Score, filter, deduplicate. Texts are written for surviving rows only."""
    scored = J.score_jobs(listings, skills)
    matching = J.uid_dedup(settle_table(scored.where("skills_matched > 0").drop("description"), "scored-jobs"))
    return JobReport(matching, J.with_description_file(J.title_company_dedup(matching)), scored)


def aggregate_jobs(landed: DataFrame, skills: list[str], max_pages: int | None = 3) -> JobReport:
    return report(normalise(page_window(landed, max_pages)), skills)
