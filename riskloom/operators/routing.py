"""Ranking of human agents for cases, by a threshold over classes of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import normalize_or_empty
from riskloom.operators.scaling import small_side, top_rows
from riskloom.session import materialize_counted

# Weights of the soft criteria, agent types, shifts and languages.
WEIGHT_SPECIALTY, WEIGHT_ACCENT, WEIGHT_COUNTRY, WEIGHT_SHIFT, WEIGHT_CHAT = 40, 20, 15, 15, 10
WEIGHT_EXPERIENCE = {"specialist": 10, "senior": 7, "mid-senior": 4, "junior": 0}
CHAT_TYPES = ("digital", "hybrid")
EXCLUDED_TYPES = ("in-person",)
SHIFT_HOURS = {"morning": (6, 14), "afternoon": (14, 22), "night": (22, 6)}
LANGUAGE_PREFIXES = {"es": ("es", "sp"), "pt": ("pt", "po"), "en": ("en", "in")}
LANGUAGE_KEYWORDS = {"es": "espanol", "pt": "portugues", "en": "ingles"}
LANGUAGE_NAMES = {"es": "español", "pt": "portugués", "en": "inglés"}
DEFAULT_CSAT = 3.5

# Cases differ in these for the ranking: the hour counts by the shift it falls into.
SITUATION = ["lang", "accent", "country", "period"]
# Agents of one class get the same points for a situation.
CLASS = ["lang", "own_accent", "own_country", "own_shift"]
BONUSES = sorted({a + c + s for a in (0, WEIGHT_ACCENT) for c in (0, WEIGHT_COUNTRY) for s in (0, WEIGHT_SHIFT)})


def language_code(language: Column) -> Column:
    """es, pt or en by the first letters of the name; null for anything else."""
    head = F.left(normalize_or_empty(language), F.lit(2))
    code = F.lit(None).cast("string")
    for name, prefixes in LANGUAGE_PREFIXES.items():
        code = F.when(head.isin(*prefixes), name).otherwise(code)
    return code


def period_of(hour: Column) -> Column:
    """The shift that an hour falls into; the night goes over midnight. Null without an hour."""
    result = F.lit(None).cast("string")
    for label, (start, end) in SHIFT_HOURS.items():
        inside = ((hour >= start) & (hour < end)) if start < end else ((hour >= start) | (hour < end))
        result = F.when(inside, label).otherwise(result)
    return result


def _mapped(key: Column, values: dict[str, int | str], default) -> Column:
    result = F.lit(default)
    for name, value in values.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def speakers(agents: DataFrame) -> DataFrame:
    """One row per agent and language; agents who cannot take a chat are left out."""
    spoken = normalize_or_empty(F.col("languages"))
    codes = F.filter(F.array(*[F.when(spoken.contains(word), F.lit(code)) for code, word in LANGUAGE_KEYWORDS.items()]),
                     lambda c: c.isNotNull())
    return agents.filter(~normalize_or_empty(F.col("agent_type")).isin(*EXCLUDED_TYPES)).withColumn(
        "lang", F.explode(codes))


def _matches() -> tuple[Column, Column, Column]:
    """Whether accent, country and shift of a class suit a situation. Rotating agents suit every shift."""
    accent = (F.col("accent") != "") & (F.col("accent") != "neutral") & (F.col("own_accent") == F.col("accent"))
    country = (F.col("country") != "") & (F.col("own_country") == F.col("country"))
    shift = (F.col("own_shift") == "rotating") | F.coalesce(F.col("own_shift") == F.col("period"), F.lit(False))
    return accent, country, shift


def _points(condition: Column, weight: int) -> Column:
    return F.when(condition, weight).otherwise(0)


def class_lists(agents: DataFrame, top: int) -> DataFrame:
    """The first `top` agents of every class for every sum of points that a situation can add, ranked by `place`.

    The points of a situation are the same for a whole class, so nobody behind these can be among the first
    `top` of any situation.
    """
    specialist = normalize_or_empty(F.col("specialty")).contains("fraude")
    chat = normalize_or_empty(F.col("agent_type")).isin(*CHAT_TYPES)
    described = speakers(agents).withColumns({
        "own_accent": normalize_or_empty(F.col("native_accent")), "own_country": normalize_or_empty(F.col("country_of_origin")),
        "own_shift": normalize_or_empty(F.col("work_shift")), "specialist": specialist, "chat": chat,
        "bonus": F.explode(F.array(*[F.lit(b) for b in BONUSES]))})
    whole = F.col("bonus") + _points(specialist, WEIGHT_SPECIALTY) + _points(chat, WEIGHT_CHAT) + _mapped(
        normalize_or_empty(F.col("experience_level")), WEIGHT_EXPERIENCE, 0)
    score = whole + F.coalesce("avg_csat", F.lit(DEFAULT_CSAT)) * 3 - F.coalesce("total_monthly_interactions", F.lit(0.0)) / 100
    scored = described.withColumn("routing_score", F.bround(score, 1))
    return top_rows(scored, [*CLASS, "bonus"], [F.col("routing_score").desc(), F.col("agent_id")], top, rank="place")


def _reasons() -> Column:
    accent, country, shift = _matches()

    def reason(condition: Column, text: str, detail: str | None = None) -> Column:
        words = F.lit(text) if detail is None else F.concat(F.lit(f"{text} ("), F.col(detail), F.lit(")"))
        return F.when(condition, words)

    why = F.array(F.concat(F.lit("habla "), _mapped(F.col("lang"), LANGUAGE_NAMES, "")),
                  reason(F.col("specialist"), "especialista en fraudes"), reason(accent, "mismo acento", "native_accent"),
                  reason(country, "mismo país", "country_of_origin"), reason(shift, "en turno", "work_shift"),
                  reason(F.col("chat"), "atiende chat", "agent_type"))
    return F.array_join(F.filter(why, lambda w: w.isNotNull()), "; ")


def rank_agents(cases: DataFrame, agents: DataFrame, top: int = 3) -> DataFrame:
    """The best agents of every case (case_id, language, accent, country, hour), ranked from 1.

    Language is a hard condition. A score is the agent's own points plus those for accent, country and shift, so
    agents are ranked once within their class, and a situation looks at the head of each class first: the best
    `top` agents belong to the `top` classes with the best heads, as every other class is below all of these. It
    then reads `top` agents of these classes. Equal scores go by agent id. Cases join the winners of their situation.
    """
    described = cases.select("case_id", language_code(F.col("language")).alias("lang"),
                             normalize_or_empty(F.col("accent")).alias("accent"),
                             normalize_or_empty(F.col("country")).alias("country"),
                             F.coalesce(period_of(F.col("hour").cast("int")), F.lit("")).alias("period"))
    described = described.filter(F.col("lang").isNotNull())
    situations = described.select(*SITUATION).distinct()
    lists, n = materialize_counted(class_lists(agents, top), "agent-classes")
    order = [F.col("routing_score").desc(), F.col("agent_id")]
    points = sum((_points(match, weight) for match, weight in zip(_matches(), (WEIGHT_ACCENT, WEIGHT_COUNTRY, WEIGHT_SHIFT))), F.lit(0))
    classes = lists.filter("place = 1").select(*CLASS).distinct()
    heads = lists.filter("place = 1").select(*CLASS, "bonus", "routing_score", "agent_id")
    offered = situations.join(small_side(classes, n), "lang").withColumn("bonus", points)
    best = top_rows(offered.join(small_side(heads, n), [*CLASS, "bonus"]), SITUATION, order, top).drop("routing_score", "agent_id")
    winners = top_rows(best.join(small_side(lists, n), [*CLASS, "bonus"]), SITUATION, order, top, rank="rank")
    chosen = winners.withColumn("routing_reasons", _reasons()).select(
        *SITUATION, "rank", "agent_id", "first_name", "last_name", "email", "languages", "specialty", "agent_type", "work_shift",
        "routing_score", "routing_reasons")
    return described.join(chosen, SITUATION)


def escalations(cases: DataFrame, agents: DataFrame, created_at: Column) -> DataFrame:
    """One row per case to escalate: the best agent, or pending when nobody speaks the language.

    An unknown language counts as Spanish.
    """
    lang = F.coalesce(language_code(F.col("language")), F.lit("es"))
    known = cases.withColumn("language", lang)
    best = rank_agents(known, agents, top=1).select("case_id", "agent_id", "first_name", "last_name", "routing_score",
                                                    "routing_reasons")
    name = F.when(F.col("agent_id").isNotNull(), F.concat_ws(" ", "first_name", "last_name"))
    identifier = F.concat(F.lit("ESC-"), F.upper(F.left(F.md5("case_id"), F.lit(12))))
    return known.join(best, "case_id", "left").select(
        identifier.alias("escalation_id"), "case_id", "customer_id", "agent_id", name.alias("agent_name"), "language",
        "reason", "summary", "routing_score", "routing_reasons", created_at.alias("created_at"),
        F.when(F.col("agent_id").isNotNull(), "open").otherwise("pending_no_agent").alias("status"))
