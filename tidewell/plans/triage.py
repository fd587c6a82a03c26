"""Triage over the conversations: every patient turn is followed by one of a few sentences, chosen by its number, since the
tables' own words are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import triage as T
from tidewell.operators import triage_values as V
from tidewell.plans import standins as S
from tidewell.plans.registry import query
from tidewell.plans.standins import with_tables

#: Sentence, as normalised, codes, worst urgency, reasons.
SENTENCES = [
    ("Tengo treinta y nueve de fiebre", "tengo 39 de fiebre", "fiebre_alta", "urgente", "fiebre de 39 grados"),
    ("La herida no sangra", "la herida no sangra", None, None, None),
    ("Me sale mucha sangre por la herida", "me sale mucha sangre por la herida", "sangrado_activo", "urgente", "sangrado activo en la herida"),
    ("Se me soltó un punto de la herida", "se me solto un punto de la herida", "dehiscencia", "urgente", "la herida se ha abierto (dehiscencia)"),
    ("Me cuesta mucho respirar y me duele el pecho", "me cuesta mucho respirar y me duele el pecho", "dolor_toracico,disnea", "urgente", "dolor torácico; dificultad respiratoria"),
    ("Solo veo una manchita de sangre", "solo veo una manchita de sangre", None, None, None),
    ("La herida huele mal y tengo 38 grados", "la herida huele mal y tengo 38 grados", "signos_infeccion", "prioritaria", "signos de infección en la herida"),
    ("Hoy va todo de maravilla", "hoy va todo de maravilla", None, None, None),
    ("No puedo respirar", "no puedo respirar", "disnea", "urgente", "dificultad respiratoria"),
    ("Tengo mucha fiebre y huele mal", "tengo mucha fiebre y huele mal", "signos_infeccion,fiebre_referida", "prioritaria", "signos de infección en la herida; fiebre alta referida sin termómetro"),
    ("Tengo 39 años", "tengo 39 anos", None, None, None),
    ("No sé si la herida está sangrando", "no se si la herida esta sangrando", "sangrado", "urgente", "sangrado de la herida"),
]


def spoken(spark, d) -> DataFrame:
    """The conversations' turns; the patient's end with a sentence of the list."""
    said = F.element_at(F.array(*(F.lit(s[0]) for s in SENTENCES)), (F.pmod(F.col("id") + F.col("call_id"), F.lit(len(SENTENCES))) + 1).cast("int"))
    return S.turns(spark, d).withColumn("content", F.when(F.col("role") == "patient", F.concat("content", F.lit(". "), said, F.lit("."))).otherwise(F.col("content")))


def _values() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x + "'"
    return ", ".join(f"({i}, {', '.join(map(quoted, s))})" for i, s in enumerate(SENTENCES))


SPOKEN = f"said AS (SELECT t.call_id, t.id, t.role, t.content, v.* FROM turns t JOIN (VALUES {_values()}) v(k, sentence, normal, codes, urgency, reasons) ON v.k = (t.id + t.call_id) % {len(SENTENCES)} WHERE t.role = 'patient'), flagged AS (SELECT * FROM said WHERE codes IS NOT NULL)"


NORMAL = r"trim(regexp_replace(regexp_replace(strip_accents(lower(content)), '\b(?:e+h+|a+h+|em|mm+|umm+|o\s+sea|osea|digamos|pues)\b', ' ', 'g'), '\s+', ' ', 'g')) || '. ' || normal || '.'"
#: Where each sentence's flags are found in it: its number, the code, the words that the rule matches.
PLACES = [
    (0, "fiebre_alta", "39"), (2, "sangrado_activo", "mucha sangre"), (3, "dehiscencia", "se me solto un punto"), (4, "dolor_toracico", "me duele el pecho"), (4, "disnea", "me cuesta mucho respirar"),
    (6, "signos_infeccion", "huele mal"), (8, "disnea", "no puedo respirar"), (9, "signos_infeccion", "huele mal"), (9, "fiebre_referida", "mucha fiebre"), (11, "sangrado", "la herida esta sangrando"),
]
#: The excerpt of a flag: its words and what stands around them; the sentence is the text's end.
EXCERPTS = f""", places AS (SELECT * FROM (VALUES {", ".join(map(str, PLACES))}) v(form, code, words)),
found AS (SELECT id, code, words, n, length(n) - length(normal) - 1 + strpos(normal, words) AS p FROM (SELECT id, k, normal, {NORMAL} AS n FROM said) JOIN places ON form = k),
excerpts AS (SELECT id, code, n, trim(substr(n, greatest(1, p - {V.EXCERPT_CHARS}), p + length(words) + {V.EXCERPT_CHARS} - greatest(1, p - {V.EXCERPT_CHARS}))) AS evidence FROM found)"""


def sql(body: str) -> str:
    return with_tables("turns", f", {SPOKEN} {body}")


@query("tr1", sql("SELECT call_id, id FROM said"))
def tr1(spark, d) -> DataFrame:
    return T.patient_turns(spoken(spark, d)).select("call_id", "id")


@query("tr2", sql(f"SELECT id, {NORMAL} AS normal FROM said"))
def tr2(spark, d) -> DataFrame:
    return T.patient_turns(spoken(spark, d)).select("id", T.speech_normalised(F.col("content")).alias("normal"))


@query("tr3", sql("SELECT id FROM said WHERE k IN (0, 2, 3, 4, 6, 8, 9, 10, 11, 1)"))
def tr3(spark, d) -> DataFrame:
    """Turns in which some pattern is found, whether denied or not."""
    return T.rule_hits(spoken(spark, d)).select("id")


@query("tr4_whole", sql(f"{EXCERPTS} SELECT id, code, evidence FROM excerpts WHERE regexp_matches(n, '{V.NEGATORS}')"))
@query("tr4", sql(f"{EXCERPTS} SELECT id, code, evidence FROM excerpts WHERE regexp_matches(n, '{V.NEGATORS}')"))
def tr4(spark, d) -> DataFrame:
    """Flags of every turn in whose normalised text a negator is found: those that it doesn't reach are all that is left."""
    turns = spoken(spark, d)
    denied = T.rule_hits(turns).filter(F.rlike("normal", F.lit(V.NEGATORS))).select("id")
    return T.flags(turns).join(denied, "id", "left_semi").select("id", "code", "evidence")


@query("tr5", sql("SELECT id, codes FROM flagged WHERE codes LIKE 'sangrado%'"))
def tr5(spark, d) -> DataFrame:
    """Bleeding flags; plain bleeding told with a diminutive has none."""
    return T.flags(spoken(spark, d)).filter(F.col("code").startswith("sangrado")).select("id", F.col("code").alias("codes"))


@query("tr6", sql("SELECT id, 39.0::DOUBLE AS value FROM flagged WHERE k = 0"))
def tr6(spark, d) -> DataFrame:
    return T.flags(spoken(spark, d)).filter("code = 'fiebre_alta'").select("id", "value")


@query("tr7", sql("SELECT id, unnest(string_split(codes, ',')) AS code FROM flagged"))
def tr7(spark, d) -> DataFrame:
    return T.flags(spoken(spark, d)).select("id", "code")


@query("tr8_whole", sql(f"{EXCERPTS} SELECT id, code, evidence FROM excerpts"))
@query("tr8", sql(f"{EXCERPTS} SELECT id, code, evidence FROM excerpts"))
def tr8(spark, d) -> DataFrame:
    """Every flag with its excerpt."""
    return T.flags(spoken(spark, d)).select("id", "code", "evidence")


@query("tr9", sql("SELECT call_id, id, urgency, codes, reasons FROM flagged"))
def tr9(spark, d) -> DataFrame:
    return T.summaries(T.flags(spoken(spark, d)))


@query("tr10", sql(", nxt AS (SELECT id, lead(id) OVER (PARTITION BY call_id ORDER BY id) AS confirm_id FROM said), firsts AS (SELECT call_id, min(id) AS alarm_id, count(*) - 1 AS later_alarms FROM flagged GROUP BY 1) SELECT f.call_id, f.alarm_id, n.confirm_id, f.later_alarms FROM firsts f JOIN nxt n ON n.id = f.alarm_id"))
def tr10(spark, d) -> DataFrame:
    turns = spoken(spark, d)
    return T.alarm_phases(turns, T.summaries(T.flags(turns)))


@query("tr11", sql("SELECT call_id, id, 'system' AS role, 'ALARMA DETECTADA — «' || reasons || '» (Urgencia: ' || urgency || ')' AS content FROM flagged f WHERE id = (SELECT min(id) FROM flagged g WHERE g.call_id = f.call_id)"))
def tr11(spark, d) -> DataFrame:
    return T.audit_turns(T.summaries(T.flags(spoken(spark, d))))
