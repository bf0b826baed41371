"""Which tools and templates questions ask for: an ordered decision list over what each question says.

What a question says is a set of names: of phrases that it holds, and of a few shapes, a bit each.  A rule is a row of data, a template with
the names that call for it; rules are tried in order, all questions in one pass over their table.  Amounts, periods and limits are read from the
question's tokens by small rules that look at a place and those after it; tokens are slow to look at, so this is left out where a question
lacks a word that its rule needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import once

# The phrases by which questions are told apart.
PHRASES: dict[str, tuple[str, ...]] = {
    "counted": ("how many", "count", "rate", "funnel", "conversion", "waiting on", "overdue", "follow-up", "follow up"),
    "listed": ("which roles", "which sources", "which companies", "what companies", "list companies", "which month", "busiest month", "most applications", "list applications", "latest application", "most recent application", "last application"),
    "content": ("exactly", "email", "recruiter", "said", "say", "mentioned", "feedback", "why"),
    "recent": ("this week", "last week", "this month", "last month", "this year", "last year", "past 7 days", "last 7 days"),
    "timing": ("average time", "how long does it take", "time to first response", "time-to-first-response", "time to rejection", "time-to-rejection"),
    "silence": ("ghost threshold", "days of silence", "effectively dead"),
    "volume": ("application volume", "applications trended", "applications over time"),
    "response_trend": ("response rate improving", "response rate trend", "response rate over time"),
    "successes": ("successful application", "successful applications", "wins have in common"),
    "failures": ("rejected/ghosted application", "rejected or ghosted application", "rejected and ghosted application", "negative outcomes have in common"),
    "correlate": ("strongest response correlate", "single factor correlates most", "correlates most with getting a response", "most correlated with response"),
    "wasted": ("wasted effort", "pouring effort", "never converts", "never convert", "lowest conversion"),
    "best_source": ("best roi source", "source gives the best roi", "best source for interviews", "most interviews per application"),
    "sponsorship_impact": ("sponsorship requirement measurably hurting", "sponsorship requirement hurting", "sponsorship hurting my response rate", "sponsorship hurt my response rate", "response rate impact of sponsorship", "sponsorship response impact"),
    "skills": ("skills actually sell", "skills that sell", "skill signals", "dead-weight skill", "dead weight skill", "skills correlate with interviews"),
    "adjacent": ("adjacent role", "roles i don't apply to", "roles i do not apply to", "roles should i explore", "roles should i consider"),
    "month": ("which month", "busiest month", "most applications"),
    "companies": ("which companies", "what companies", "list companies"),
    "shown": ("show those applications", "show the applications", "list applications"),
    "waiting": ("waiting on", "overdue", "follow-up", "follow up"),
    "funnel": ("funnel",),
    "rates": ("rate", "conversion"),
    "web": ("evidence-based", "cite sources", "cite useful sources", "with sources", "current statistics", "industry benchmark", "people typically", "people usually", "latest research"),
    "successful": ("successful",), "application": ("application",), "common": ("in common",), "rejected": ("rejected",), "ghosted": ("ghosted",),
    "skill": ("skill",), "sell": ("sell", "dead weight"), "correlates": ("correlate",), "interviews": ("interview",),
}
INSIGHTS = (
    ("weekly_actions", ("3 concrete things i should do next week", "three concrete things i should do next week", "what should i do next week", "actions should i take next week", "next-week actions", "weekly actions")),
    ("why_rejected", ("why am i getting rejected", "why do i keep getting rejected", "why i am getting rejected", "recurring themes across rejection", "rejection themes")),
    ("recurring_feedback", ("feedback consistently say", "feedback says i should improve", "feedback say i should improve", "feedback says i need to improve", "feedback say i need to improve", "recurring feedback", "consistent feedback")),
    ("skill_gaps", ("skills keep appearing in roles i get rejected from", "technologies keep appearing in roles i get rejected from", "real skill gaps", "skill gaps")),
    ("strongest_weakest_signals", ("strongest and weakest signals", "strongest & weakest signals", "strongest/weakest signals")),
    ("role_fit", ("roles genuinely suit me best", "roles suit me best", "best-fit roles", "best fit roles", "pattern of my wins")),
    ("story", ("story my last 6-12 months of job searching tells", "story my last 6 to 12 months of job searching tells", "job search story", "story of my job search", "search story")),
)
SOURCES = (("linkedin", ("linkedin",)), ("company_site", ("company site", "company website", "careers page")), ("indeed", ("indeed",)), ("referral", ("referral", "referred")), ("other", ("other source",)))
WORK_MODES = (("remote", ("remote", "fully remote")), ("hybrid", ("hybrid",)), ("onsite", ("onsite", "on-site", "on site")))
SPONSORSHIPS = (
    ("not_offered", ("didn't offer sponsorship", "did not offer sponsorship", "not offered sponsorship", "without sponsorship", "no sponsorship")),
    ("unknown", ("sponsorship unknown", "unknown sponsorship")),
    ("offered", ("offered sponsorship", "offers sponsorship", "offer sponsorship", "with sponsorship")),
)
STATUSES = (
    ("applied", ("at the applied stage", "current status is applied")), ("in_review", ("in review", "under review")),
    ("assessment", ("in the assessment stage", "at the assessment stage", "currently in assessment")),
    ("interview", ("currently interviewing", "in the interview stage", "at the interview stage")), ("offer", ("at the offer stage", "currently at offer stage")),
    ("rejected", ("rejected application", "currently rejected")), ("ghosted", ("ghosted application", "currently ghosted")), ("withdrawn", ("withdrawn application", "currently withdrawn")),
)
DIMENSIONS = (
    ("role", ("by role", "which role", "job title")), ("source", ("by source", "which source", "application source")), ("salary", ("by salary", "salary band")), ("company_type", ("company type",)),
    ("industry", ("by industry", "which industry")), ("tech", ("by tech", "tech stack", "which technolog", "which skill")), ("sponsorship", ("by sponsorship", "sponsorship vs")),
    ("seniority", ("by seniority", "seniority level")), ("work_mode", ("work mode", "remote vs", "hybrid vs", "onsite vs", "on-site vs")),
)
PERIODS = (("last week", "last_week"), ("this week", "this_week"), ("last month", "last_month"), ("this month", "this_month"), ("last year", "last_year"), ("this year", "this_year"))
NOT_ROLES = ("hybrid", "on site", "on-site", "onsite", "remote")
CURRENT = "Current user question:"
#: What a question may say: phrases, and shapes (``routed``).
NAMES = (*PHRASES, "newest_listed", "two_sources", "dimension", "two_sources_ever")


def _bits(*names: str) -> Column:
    return F.lit(sum(1 << NAMES.index(n) for n in names)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``template`` is asked for by any of ``says``, or by all of one of ``together``."""

    template: str
    says: tuple[str, ...] = ()
    together: tuple[tuple[str, ...], ...] = ()

    def holds(self, said: Column) -> Column:
        out = said.bitwiseAND(_bits(*self.says)) != 0
        for names in self.together:
            out = out | (said.bitwiseAND(_bits(*names)) == _bits(*names))
        return out


#: In order: the first rule that holds decides.
RULES = (
    Rule("busiest_application_month", ("month",)),
    Rule("company_list", ("companies",)),
    Rule("application_list", ("shown", "newest_listed")),
    Rule("live_applications", ("waiting",)),
    Rule("funnel", ("funnel",)),
    Rule("timing", ("timing",)),
    Rule("personal_ghost_threshold", ("silence",)),
    Rule("response_rate_timeseries", ("response_trend",)),
    Rule("successful_application_segments", ("successes",), (("successful", "application", "common"),)),
    Rule("negative_outcome_segments", ("failures",), (("application", "common", "rejected", "ghosted"),)),
    Rule("strongest_response_correlate", ("correlate",)),
    Rule("wasted_effort_segments", ("wasted",)),
    Rule("best_roi_source", ("best_source",)),
    Rule("sponsorship_response_impact", ("sponsorship_impact",)),
    Rule("skill_signal_segments", ("skills",), (("skill", "sell"), ("skill", "correlates", "interviews"))),
    Rule("adjacent_role_suggestions", ("adjacent",)),
    Rule("application_timeseries", ("volume",)),
    Rule("breakdown", ("two_sources", "dimension")),
    Rule("rates", ("rates",)),
)
OTHERWISE = "summary_counts"
#: What makes a question one of numbers besides these rules.
_BY_RULE = tuple(r for r in RULES if r.template not in ("busiest_application_month", "company_list", "live_applications", "funnel", "breakdown", "rates"))
#: Templates that take a period of their own, and those that take a limit.
DATED = ("busiest_application_month", "company_list", "application_list", "summary_counts")
LIMITED = ("company_list", "application_list")
DEFAULT_LIMIT, MOST_LIMIT = 20, 100


# -- tokens ----------------------------------------------------------------------------------------------------------------------


def tokens(q: Column) -> Column:
    """Words, numbers (with letters that follow at once) and signs."""
    return F.regexp_extract_all(q, F.lit(r"\d+[a-z]*|[a-z]+(?:'[a-z]+)*\d*|[^\sa-z\d]"), F.lit(0))


def _first(t: Column, read: Callable[[Column, Column], Column]) -> Column:
    """read(tokens, place) of the first place where it isn't null."""
    found = F.transform(t, lambda _, i: read(t, i))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _is(t: Column, i: Column, *words: str) -> Column:
    return F.coalesce(F.get(t, i).isin(*words), F.lit(False))


def _skip(t: Column, i: Column, *words: str) -> Column:
    """The place after i if one of the words stands there, else i."""
    return i + F.when(_is(t, i, *words), 1).otherwise(0)


def _digits(t: Column, i: Column, least: int, most: int) -> Column:
    """The whole number at a place, of so many digits."""
    return F.when(F.get(t, i).rlike(rf"^\d{{{least},{most}}}$"), F.get(t, i).cast("int"))


def requested_limit(t: Column) -> Column:
    """The first number of up to three digits, within bounds; else the default (Q05)."""
    n = F.coalesce(_first(t, lambda t, i: _digits(t, i, 1, 3)), F.lit(DEFAULT_LIMIT))
    return F.greatest(F.lit(1), F.least(F.lit(MOST_LIMIT), n))


def period(q: Column, t: Column) -> tuple[Column, Column, Column]:
    """kind, days, year of the period that a question and its tokens name: a calendar one, the past days, or a year (Q05)."""
    named = F.coalesce(*[F.when(q.contains(phrase), kind) for phrase, kind in PERIODS])
    days = F.when(q.contains("day") & _holds(q, ("past", "last")), _first(t, lambda t, i: F.when(_is(t, i, "past", "last") & _is(t, i + 2, "day", "days"), _digits(t, i + 1, 1, 4))))
    year = F.when(q.rlike(r"\d{4}"), _first(t, lambda t, i: F.when(_is(t, i, "in", "during") & F.coalesce(_digits(t, i + 1, 4, 4), F.lit(0)).between(1900, 2099), _digits(t, i + 1, 4, 4))))
    kind = F.coalesce(named, F.when(days.isNotNull(), "rolling_days"), F.when(year.isNotNull(), "calendar_year"))
    return kind, F.when(kind == "rolling_days", days), F.when(kind == "calendar_year", year)


def amounts(q: Column) -> Column:
    """Tokens with each amount of money as one: '=' and its value, thousands spelled out.  Null where no salary is spoken of."""
    plain = F.regexp_replace(q, r"(?<=\d),(?=\d)", "")
    pieces = F.regexp_extract_all(F.regexp_replace(plain, r"[$£€]\s*(?=\d)", ""), F.lit(r"\d+(?:\.\d+)?(?:\s*k\b)?|[a-z]+|[^\sa-z\d]"), F.lit(0))
    value = lambda p: (F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * F.when(p.endswith("k"), 1000).otherwise(1)).cast("long")
    return F.when(q.contains("salary"), F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("="), value(p).cast("string"))).otherwise(p)))


def salary_range(t: Column) -> tuple[Column, Column]:
    """The lower and upper salary that a question's tokens (``amounts``) name (F24), null where they name none.

    'salary [is|of] [between] A -|to|and B', if A isn't above B; else 'salary [of] at least|over|above|from A' or 'salary [of] at most|under|below|up to B'."""
    amount = lambda t, i: F.when(F.get(t, i).startswith("="), F.substring(F.get(t, i), 2, 30).cast("long"))

    def ranged(t: Column, i: Column) -> Column:
        at = _skip(t, _skip(t, i + 1, "is", "of"), "between")
        both = F.struct(amount(t, at).alias("low"), amount(t, at + 2).alias("high"))
        return F.when(_is(t, i, "salary") & _is(t, at + 1, "-", "to", "and") & both["low"].isNotNull() & both["high"].isNotNull(), both)

    def bounded(one: tuple[str, ...], first: str, second: str) -> Callable[[Column, Column], Column]:
        def read(t: Column, i: Column) -> Column:
            at = _skip(t, i + 1, "of")
            return F.when(_is(t, i, "salary"), F.coalesce(F.when(_is(t, at, *one), amount(t, at + 1)) if one else F.lit(None).cast("long"), F.when(_is(t, at, first) & _is(t, at + 1, second), amount(t, at + 2))))

        return read

    both = _first(t, ranged)
    low = _first(t, bounded(("over", "above", "from"), "at", "least"))
    high = F.coalesce(_first(t, bounded(("under", "below"), "at", "most")), _first(t, bounded((), "up", "to")))

    def judged(s: Column) -> Column:
        both, low, high = s["both"], s["low"], s["high"]
        sound = both.isNotNull() & (both["low"] <= both["high"])
        return F.struct(F.when(sound, both["low"]).when(both.isNull(), low).alias("lower"), F.when(sound, both["high"]).when(both.isNull() & low.isNull(), high).alias("upper"))

    told = F.when(t.isNotNull(), once(F.struct(both.alias("both"), low.alias("low"), high.alias("high")), judged))
    return told["lower"], told["upper"]


def requested_role(q: Column) -> Column:
    """The role that a question asks for: in quotes after 'role' or 'job title', or between 'application(s) for' and 'role', 'position' or 'job'."""
    speaks = _holds(q, ("role", "position", "job"))
    quoted = [F.regexp_extract(q, rf"\b(?:role|job title) (?:is )?{mark}([^'\"]{{1,100}}){mark}", 1) for mark in ("'", '"')]
    told = F.regexp_extract(F.regexp_replace(q, r"\s+", " "), r"\bapplications? for (?:an? )?(.{1,100}?) (?:role|position|job)s?\b", 1)
    plain = F.nullif(F.trim(told), F.lit(""))
    return F.when(speaks, F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in quoted], F.when(~plain.isin(*NOT_ROLES), plain)))


# -- questions -------------------------------------------------------------------------------------------------------------------


def _holds(q: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | q.contains(p)
    return out


def _count(q: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """How many values of a table a question names."""
    return reduce(Column.__add__, [F.when(_holds(q, phrases), 1).otherwise(0) for _, phrases in table])


def _first_named(q: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first value, in the table's order, that a question names."""
    return F.coalesce(*[F.when(_holds(q, phrases), value) for value, phrases in table])


def _only(q: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    return F.when(_count(q, table) == 1, _first_named(q, table))


def _newest(t: Column, nouns: tuple[str, ...], counted: bool) -> Column:
    """Does a question ask for the latest, last or most recent application(s), with a number before the noun or not?"""

    def asks(i: Column) -> Column:
        first = _is(t, i, "latest", "last") | ((i > 0) & _is(t, i, "recent") & _is(t, F.greatest(i - 1, F.lit(0)), "most"))
        number = F.when(_digits(t, i + 1, 1, 3).isNotNull(), 1).otherwise(0) if counted else F.lit(0)
        return first & _is(t, i + 1 + number, *nouns)

    return F.exists(F.transform(t, lambda _, i: asks(i)), lambda x: x)


def current_question(text: Column) -> Column:
    """What is asked now, without the questions that it leans on."""
    return F.when(text.contains(CURRENT), F.trim(F.substring_index(text, CURRENT, -1))).otherwise(text)


def routed(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds to each question its route, insight, template, dimension, period, limit and filters.

    A null question is an empty one.  The route and the template go by the whole text, filters, period and limit by what is asked now."""
    said_now = F.lower(current_question(F.coalesce(F.col(text), F.lit(""))))
    step = questions.withColumns({"_q": F.lower(F.coalesce(F.col(text), F.lit(""))), "_now": said_now})
    may_ask = F.col("_q").contains("application") & _holds(F.col("_q"), ("latest", "last", "recent"))
    step = step.withColumns({"_t": F.when(may_ask, tokens(F.col("_q"))), "_money": amounts(F.col("_now"))})
    q, now, t, tn = (F.col(c) for c in ("_q", "_now", "_t", "_tn"))
    newest = F.coalesce(_newest(t, ("application", "applications"), True), F.lit(False))
    shapes = {"newest_listed": newest, "two_sources": _count(now, SOURCES) > 1, "dimension": _first_named(q, DIMENSIONS).isNotNull(), "two_sources_ever": _count(q, SOURCES) > 1}
    held = {name: _holds(q, phrases) for name, phrases in PHRASES.items()} | shapes
    bits = reduce(Column.bitwiseOR, [F.when(held[name], _bits(name)).otherwise(F.lit(0).cast("long")) for name in NAMES])
    step = step.withColumns({"_said": bits, "_dimension": _first_named(q, DIMENSIONS), "insight": _first_named(q, INSIGHTS)})
    said = F.col("_said")
    numbers = Rule("", ("counted", "listed", "recent", "dimension", "two_sources_ever")).holds(said)
    for rule in _BY_RULE:
        numbers = numbers | rule.holds(said)
    any_of = lambda *n: Rule("", n).holds(said)
    route = (
        F.when(F.col("insight").isNotNull(), F.when(any_of("counted"), "mixed").otherwise("content"))
        .when(numbers & any_of("content"), "mixed").when(numbers, "quantitative").otherwise("content")
    )
    template = F.coalesce(*[F.when(rule.holds(said), rule.template) for rule in RULES], F.lit(OTHERWISE))
    kind, days, year = period(now, tn)
    low, high = salary_range(F.col("_money"))
    step = step.withColumns({"route": route, "template": template, "_status": _only(now, STATUSES)})
    step = step.withColumn("_tn", F.when(now.rlike(r"\d") | (F.col("template") == "application_list"), tokens(now))).withColumn("_kind", kind)
    kind, status, compared = F.col("_kind"), F.col("_status"), dict(DIMENSIONS)
    sponsorship = F.when(~_holds(now, compared["sponsorship"]), _first_named(now, SPONSORSHIPS))
    chosen = F.col("template")
    return step.withColumns(
        {
            "dimension": F.when(chosen == "breakdown", F.when(any_of("two_sources"), "source").otherwise(F.col("_dimension"))),
            "window_kind": F.when(chosen.isin(*DATED), kind), "window_days": F.when(chosen.isin(*DATED), days), "window_year": F.when(chosen.isin(*DATED), year),
            "list_limit": F.when(chosen.isin(*LIMITED), F.when((chosen == "application_list") & _newest(tn, ("application",), False), 1).otherwise(requested_limit(tn))),
            "source": _only(now, SOURCES), "work_mode": F.when(~_holds(now, compared["work_mode"]), _only(now, WORK_MODES)),
            "sponsorship": F.when(chosen != "sponsorship_response_impact", sponsorship),
            "status": F.when(~((chosen == "negative_outcome_segments") & F.coalesce(status.isin("rejected", "ghosted"), F.lit(False))), status),
            "role": requested_role(now), "salary_min": low, "salary_max": high,
        }
    ).drop("_q", "_now", "_t", "_tn", "_money", "_said", "_dimension", "_status", "_kind")


def seen_between(kind: Column, year: Column, at: Column) -> tuple[Column, Column]:
    """The bounds on first_seen of a period as a filter (X39): a calendar year, or the week, month or else year of ``at``, to the last microsecond."""
    unit = F.when(kind == "this_week", "WEEK").when(kind == "this_month", "MONTH").when(kind != "calendar_year", "YEAR")
    starts = {u: F.date_trunc(u, at).cast("timestamp_ntz") for u in ("WEEK", "MONTH", "YEAR")}
    starts[""] = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    lengths = {"WEEK": F.expr("INTERVAL 7 DAYS"), "MONTH": F.expr("INTERVAL 1 MONTH"), "YEAR": F.expr("INTERVAL 1 YEAR"), "": F.expr("INTERVAL 1 YEAR")}
    of = F.when(kind == "calendar_year", "").otherwise(unit)
    first = F.coalesce(*[F.when(of == u, s) for u, s in starts.items()])
    after = F.coalesce(*[F.when(of == u, s + lengths[u]) for u, s in starts.items()])
    return first, after - F.expr("INTERVAL 1 MICROSECOND")


def overridden(plans: DataFrame, text: str = "question") -> DataFrame:
    """What becomes of a model's plans (Q07): plan_route, plan_template, plan_window_kind, and whether it has plan_retrieval, plan_insight, plan_web.

    Routes that the rules know for certain win over the model's; its window stays; talk that needs sources goes to the web; a mixed question
    without any content tool is a fault.  Adds final_route, final_template, final_window_kind, fault and tools, in the order that they run (X40)."""
    r = routed(plans, text)
    talks = F.col("plan_route").isin("conversation", "web")
    route = F.when((F.col("plan_route") == "conversation") & _holds(F.lower(F.col(text)), PHRASES["web"]), "web").when(~talks & F.col("route").isin("quantitative", "mixed"), F.col("route")).otherwise(F.col("plan_route"))
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    content = yes("plan_retrieval") | yes("plan_insight") | yes("plan_web")
    ruled = ~talks & F.col("route").isin("quantitative", "mixed")
    template = F.when(ruled, F.col("template")).when(route.isin("quantitative", "mixed"), F.col("plan_template"))
    window = F.when(ruled & (F.col("route") == "quantitative"), F.coalesce("plan_window_kind", "window_kind")).when(ruled, F.col("window_kind")).otherwise(F.col("plan_window_kind"))
    out = r.withColumns({"final_route": route, "final_template": template, "final_window_kind": window, "fault": F.when(ruled & (F.col("route") == "mixed") & ~content, "no content tool")})
    final = F.col("final_route")
    uses = {
        "structured_query": F.when(final == "quantitative", True).when(final == "mixed", F.col("final_template").isNotNull()),
        "semantic_search": ((final == "mixed") | ((final == "content") & ~yes("plan_insight"))) & (yes("plan_retrieval") | (final == "content")),
        "cached_insight": final.isin("mixed", "content") & yes("plan_insight"),
        "web_search": F.when(final == "web", True).when(final == "mixed", yes("plan_web")),
    }
    tools = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in uses.items()]), lambda x: x.isNotNull())
    return out.withColumn("tools", F.when(F.col("fault").isNull(), tools).otherwise(F.array().cast("array<string>")))


def citation(template: Column, application_id: Column) -> Column:
    """What a row of a template's answer is cited as (X40): its application in lists of these, else the metric."""
    return F.when(template.isin("live_applications", "application_list"), F.concat(F.lit("application:"), application_id)).otherwise(F.concat(F.lit("metric:"), template))


def follow_up_prompt(template: Column) -> Column:
    """The message that an answer suggests next, null for most."""
    counted = template.isin("summary_counts", "total_applications")
    return F.when(counted, "Show me the applications included in that count.").when(template == "application_list", "Group these applications by company.").when(template == "company_list", "Show the applications for these companies.")


def classification_target(provider: Column, azure_deployment: Column, local_model: Column) -> tuple[Column, Column]:
    """The model that classifications are compared by, and whether it can run."""
    model = F.when(provider == "azure_openai", azure_deployment).otherwise(local_model)
    return model, F.coalesce(model, F.lit("")) != ""
