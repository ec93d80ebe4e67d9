"""Broken prompt and response pairs.

The last unit (line or sentence) of every answer is masked (numbers and names give
way to signs), so that answers built alike sort side by side. A unit without an end
mark is a shortened version if it is no complete unit anywhere but its neighbour in
text order, over all units, starts with it. The same comparison is made for its last
words: they show that it breaks off if other texts go on after them and hardly ever
end there. Length-limit spikes are lengths that far more unfinished answers share than
their neighbours do. Copy, refusal and language rules follow.

Defined results: one row per question id; null answers are empty; repeated rows
count once; at most one defect, the first of ``DEFECTS`` that holds; a question
without any row gives none; null questions give no copy or language defect.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.plans.cut import cut
from tracelake.plans.ordered import with_following

#: In order of precedence.
DEFECTS = ("empty", "refusal", "copy", "truncated", "language")

# Stand-ins for an answer, lower case, without marks.
NO_ANSWER = ("n/a", "na", "none", "null", "nil", "nan", "no answer", "answer", "empty", "tbd", "todo", "undefined", "нет ответа", "ответ", "пусто", "antwort", "keine antwort", "respuesta", "sin respuesta")
# Words in front of a question that is only given back.
LEAD_INS = ("so", "also", "you asked", "you ask", "your question", "question", "the question is", "q", "ты спросил", "ты спрашиваешь", "итак", "вопрос", "du fragst", "du hast gefragt", "frage", "preguntas", "preguntaste", "has preguntado", "entonces", "pregunta", "answer", "ответ", "antwort", "respuesta")
# Phrases of answers that decline, lower case.
REFUSALS = (
    "can't help with", "cannot help with", "can not help with", "unable to help", "not able to share", "cannot share", "can't share", "off limits for me", "won't discuss", "will not discuss", "cannot discuss",
    "have to decline", "must decline", "decline to answer", "rather not go into", "won't be doing that", "will not be doing that", "no answer to this will come from me", "against the rules i follow",
    "find this out without me", "can't answer that", "cannot answer that", "can't assist", "cannot assist", "not comfortable", "refuse to answer",
    "не могу помочь", "отказаться от ответа", "ответа на это от меня не будет", "такие темы я не обсуждаю", "давай оставим этот вопрос", "не буду отвечать", "не стану отвечать", "не могу ответить на", "не могу этим поделиться", "без меня", "вне моих правил", "против моих правил", "противоречит правилам", "не имею права", "не вправе",
    "darf ich nicht antworten", "kann ich nicht helfen", "möchte ich nicht", "muss ich ablehnen", "lehne ich ab", "nicht beantworten", "gebe ich keine", "darüber spreche ich nicht", "kommt von mir keine antwort",
    "no puedo ayudar con", "no debo responder", "no puedo responder", "prefiero no", "no voy a responder", "tengo que rechazar", "no hablo de", "no puedo compartir",
)
# Words of each language that the others lack.
STOPWORDS = {
    "en": "the of and that with you your was is are in on at from have has since it about which what where when how many did my said put told now for under be there this notes",
    "ru": "и в на с что это ты я по о не для из от как уже был было были если за мне меня где когда сколько какой всего начала под во",
    "de": "der die das und ist ich du dass mit von zu den dem ein eine nicht es hast habe seit wie viele waren am ende im auf für um sich der",
    "es": "el la los las que de y en un una por con has he no es lo según dijiste desde cuántos para del al fueron hay sobre esto cuando",
}
# Words that no complete answer ends with; used only where the texts themselves hardly hold a word.
OPEN_ENDS = (
    "the a an of and or but with in on at to from for that which who because since when if as by your my you is was were are it's where into than then so about "
    "и а но или в во на с со о об от до из за к ко у по для что чтобы который которая которые которое потому если как где когда не "
    "und oder aber mit in im auf an zu von für dass weil wenn als der die das den dem ein eine welche welcher welches bei nicht "
    "y o pero con en de del a al que porque si como el la los las un una por para cuando donde"
)

_END = r"[.!?…。？！][\"'»”)\]*_`]*\s*$"


def _plain(text: Column) -> Column:
    """Lower-case words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bare(text: Column) -> Column:
    """The text without bold, italics, code and quote marks around it and without a closing citation."""
    text = F.regexp_replace(text, r"\s*\(`[^`]*`[^()]*\)\s*$", "")
    text = F.regexp_replace(text, r"\*\*|__|</?[A-Za-z]+>", "")
    return F.regexp_replace(text, r"^[\s\p{Z}\p{Cf}>]+|[\s\p{Z}\p{Cf}]+$", "")


def mask(unit: Column) -> Column:
    """The words of a unit of text in lower case with signs for numbers and names, without its list mark, brackets and marks at the end of words."""
    unit = F.regexp_replace(unit, r"^(?:[-*•>\s]+|\d+[.)]\s+|[a-z]\)\s+)", "")
    unit = F.concat(F.lower(F.substring(unit, 1, 1)), F.substring(unit, 2, 1 << 30))
    unit = F.regexp_replace(unit, r"\d+", "#")
    unit = F.lower(F.regexp_replace(unit, r"(?<!\p{L})\p{Lu}\p{L}*", "@"))
    return F.trim(F.regexp_replace(F.regexp_replace(unit, r"[()\[\]{}*\"“”«»]", " "), r"[\s.!?,;:…]*(?:\s+|$)", " "))


def _units(text: Column) -> Column:
    """Lines and sentences of a text, without code fences."""
    text = F.regexp_replace(text, r"(?s)```.*?(?:```|$)", "\n")
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\s*[\r\n]+\s*"), lambda u: u.rlike(r"[\p{L}\p{N}]"))


def _tails(units: DataFrame, size: int) -> DataFrame:
    """(tail, n, n_ends): how often each run of ``size`` words stands in the weighted units (unit, n, ended), and how often as
    the end of a unit with an end mark. Where a line ends without a mark, its end says nothing and does not count."""
    words = F.split("unit", " ")
    last = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("tail"), (i == last).alias("end")))
    runs = units.where(last >= 0).select("n", "ended", F.explode(runs).alias("run")).where("ended or not run.end")
    return runs.groupBy("run.tail").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("run.end"), F.col("n")).otherwise(0)).alias("n_ends"))


def shortened(rows: DataFrame, least: int = 3, share: float = 0.01) -> DataFrame:
    """(key, sign) of the rows (key, text, whole) whose last unit is a shortened version of what other texts hold.

    ``whole`` lists texts that are complete as they stand, such as gold answers. ``sign`` is ``prefix`` where the unit is
    no complete unit anywhere and the next in text order continues it, else ``tail`` where its last word, or last two words,
    stand at least ``least`` times inside complete units and end at most ``share`` of them. Only for a last word that the
    texts hardly hold does a list of function words stand in (``word``).
    """
    units = cut(rows.select("key", F.col("text").rlike(_END).alias("ended"), _units("text").alias("units"), "whole"))
    size, one = F.size("units"), F.lit(1).cast("bigint")
    last = units.where(size > 0).select("key", "ended", (size > 1).alias("several"), mask(F.try_element_at("units", F.lit(-1))).alias("unit"))
    inner = units.select(F.explode(F.slice("units", 1, F.greatest(size - 1, F.lit(0)))).alias("unit")).groupBy("unit").agg(F.count(one).alias("n"))
    inner = inner.select(mask(F.col("unit")).alias("unit"), "n", F.col("unit").rlike(_END).alias("ended"))
    whole = units.select(F.explode("whole").alias("unit")).where("unit is not null").select(mask(F.col("unit")).alias("unit"), one.alias("n"), F.lit(True).alias("ended"))
    complete = inner.unionByName(whole).unionByName(last.where("ended").select("unit", one.alias("n"), "ended"))
    complete = cut(complete.groupBy("unit", "ended").agg(F.sum("n").alias("n")))
    loose = cut(last.where("not ended").join(complete.select("unit").distinct(), "unit", "left_anti").select("key", "several", "unit"))

    # distinct units in text order: whatever continues a unit follows it at once
    every = complete.select("unit", F.lit(False).alias("open")).unionByName(loose.select("unit", F.lit(True).alias("open")))
    every = with_following(every.groupBy("unit").agg(F.min("open").alias("open")), "unit", "after")
    begun = every.where(F.col("open") & F.col("after").startswith(F.col("unit")))
    begun = begun.select("unit", F.substring("after", F.length("unit"), F.lit(2)).rlike(r"^\p{L}{2}$").alias("inside"))
    # a whole word, sign or number may be a whole answer or line: alone, it counts only below other lines and broken off inside
    prefix = loose.join(begun, "unit").where(F.contains("unit", F.lit(" ")) | F.col("several") & F.col("inside")).select("key", F.lit("prefix").alias("sign"))

    words = F.split("unit", " ")
    seen = _tails(complete, 1).unionByName(_tails(complete, 2)).where(F.col("n") >= least).select("tail", (F.col("n_ends") <= share * F.col("n")).alias("goes_on"))
    ends = loose.where((F.size(words) > 3) | F.col("several") & (F.size(words) > 1)).select("key", F.posexplode(F.array(F.element_at(words, -1), F.array_join(F.slice(words, -2, 2), " "))).alias("two", "tail"))
    ends = ends.join(seen, "tail", "left").select("key", "two", "tail", "goes_on")
    tail = ends.where("goes_on").select("key", F.lit("tail").alias("sign"))
    word = ends.where((F.col("two") == 0) & F.col("goes_on").isNull() & F.array_contains(F.array(*map(F.lit, dict.fromkeys(OPEN_ENDS.split()))), F.col("tail"))).select("key", F.lit("word").alias("sign"))
    return prefix.unionByName(tail).unionByName(word).groupBy("key").agg(F.min("sign").alias("sign"))


def length_spikes(rows: DataFrame, least: int = 4, ratio: float = 8.0, measured: str = "text") -> DataFrame:
    """(length, n): lengths of ``measured``, over 100 characters, of unfinished texts at which a length limit shows.

    ``ratio`` times the mean of the ten lengths on either side end there. ``least``: as many that fewer may meet by chance
    where there are no others near.
    """
    lengths = rows.where(~F.col("text").rlike(_END)).groupBy(F.length(measured).alias("length")).agg(F.count(F.lit(1)).alias("n")).where("length > 100")
    near = lengths.select(F.explode(F.sequence(F.col("length") - 10, F.col("length") + 10)).alias("length"), F.col("length").alias("at"), F.col("n").alias("m")).where("at <> length")
    around = near.groupBy("length").agg((F.sum("m") / 20).alias("around"))
    return lengths.join(around, "length", "left").where((F.col("n") >= least) & (F.col("n") >= ratio * F.coalesce("around", F.lit(0.0)))).select("length", "n")


def _left_open(text: Column) -> Column:
    """Whether a text leaves a fence, bold mark or bracket open, or ends at a mark that something must follow."""
    fences = F.size(F.split(text, "```")) - 1
    brackets = F.regexp_count(text, F.lit(r"[(\[{]")) > F.regexp_count(F.regexp_replace(text, r"(?m)(?:^|\s)[a-z\d]+\)\s", " "), F.lit(r"[)\]}]"))
    bold = (F.size(F.split(text, r"\*\*")) - 1) % 2 == 1
    return (fences % 2 == 1) | bold | (~text.rlike(_END) & (brackets | text.rlike(r"[,;(\-–—:]\s*$")))


@F.pandas_udf(T.StringType())
def text_language(texts: pd.Series) -> pd.Series:
    """en, ru, de or es by function words, null if there are fewer than two or a tie."""
    sets = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}

    def one(text: str | None) -> str | None:
        words = re.findall(r"[^\W\d_]+", re.sub(r"`[^`]*`", " ", text or "").lower())
        counts = sorted(((sum(w in s for w in words), k) for k, s in sets.items()), reverse=True)
        return counts[0][1] if counts[0][0] >= 2 and counts[0][0] > counts[1][0] else None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def text_script(texts: pd.Series) -> pd.Series:
    """cyrillic or latin by the lower-case words of a text, null if it has none."""

    def one(text: str | None) -> str | None:
        words = re.findall(r"(?<!\w)[a-zа-яё]{2,}(?!\w)", text or "")
        cyrillic = sum(w[0] > "z" for w in words)
        return None if not words or 2 * cyrillic == len(words) else "cyrillic" if 2 * cyrillic > len(words) else "latin"

    return texts.map(one)


def _copies(question: Column, answer: Column, least: float = 0.7) -> Column:
    """Whether an answer is its question and at most a lead-in, with words of the question left out or not.

    At least the share ``least`` of the question's words must stand in the answer, in order, and no others.
    """
    q, a = _plain(question), _plain(answer)
    rest = F.trim(F.regexp_replace(F.replace(a, q, F.lit(" ")), r"\s+", " "))
    whole = F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" "))) & ((rest == "") | rest.isin(*LEAD_INS))
    bare = F.regexp_replace(a, "^(?:" + "|".join(sorted(LEAD_INS, key=len, reverse=True)) + ") ", "")
    asked = F.split(q, " ")

    def onward(said: Column) -> Column:
        """Whether the words stand in the question one after the other."""
        step = lambda at, w: F.when(at >= 0, F.coalesce(F.nullif(F.array_position(F.slice(asked, at + 1, F.size(asked)), w).cast("int"), F.lit(0)) + at, F.lit(-1))).otherwise(-1)
        # an answer of more words than the question cannot: most drop out here, before any word is looked up
        return (F.size(said) <= F.size(asked)) & (F.size(said) >= least * F.size(asked)) & (F.reduce(said, F.lit(0), step) > 0)

    return (F.length(q) > 0) & (whole | onward(F.split(a, " ")) | onward(F.split(bare, " ")))


def signs(rows: DataFrame) -> DataFrame:
    """(question_id, empty, refusal, copy, truncated, language): one row per question id; ``truncated`` names the sign that
    tells it, null where there is none: prefix, tail, spike, open mark or word.

    ``rows`` has question_id, question, model_answer, gold_answer_or_rubric; of repeated rows the latest
    by created_at counts.
    """
    latest = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("created_at"), F.desc_nulls_last("model_answer"))
    rows = rows.where("question_id is not null").select("question_id", "question", "model_answer", "gold_answer_or_rubric", "created_at")
    rows = rows.withColumn("nth", F.row_number().over(latest)).where("nth = 1")
    raw = F.coalesce("model_answer", F.lit(""))
    rows = cut(rows.select("question_id", "question", F.col("gold_answer_or_rubric").alias("gold"), raw.alias("raw"), _bare(raw).alias("text")))
    texts = rows.select(F.col("question_id").alias("key"), "text", F.array("gold", "question").alias("whole"))
    short = shortened(texts).withColumnRenamed("sign", "cut")
    spikes = length_spikes(rows.select("text", "raw"), measured="raw").select("length", F.lit(True).alias("spike"))
    rows = rows.join(short, rows["question_id"] == short["key"], "left").drop("key").withColumn("length", F.length("raw"))
    rows = rows.join(spikes, "length", "left")

    plain = _plain(F.regexp_replace("raw", r"\p{Cf}|</?[A-Za-z]+>", ""))
    empty = (plain == "") | F.trim(F.regexp_replace(F.lower("text"), r"[\[\](){}<>.:*`_\s-]+", " ")).isin(*NO_ANSWER)
    low = F.replace(F.lower("text"), F.lit("’"), F.lit("'"))
    refusal = F.reduce(F.array(*[F.lit(x) for x in REFUSALS]), F.lit(False), lambda seen, x: seen | F.contains(low, x))
    copy = _copies(F.col("question"), F.col("text"))
    spike = F.when(F.coalesce("spike", F.lit(False)) & ~F.col("text").rlike(_END), "spike")
    mark = F.when(_left_open(F.regexp_replace("raw", r"\s*\(`[^`]*`[^()]*\)\s*$", "")), "open mark")
    truncated = F.coalesce(F.when(F.col("cut") != "word", F.col("cut")), spike, mark, "cut")
    # what an answer says, without the question that some give back first
    said = F.replace("text", F.coalesce(F.when(F.length("question") > 0, F.col("question")), F.lit("\u0000")), F.lit(" "))
    language = (text_language(F.col("question")) != text_language(said)) | (text_script(F.col("question")) != text_script(said))
    return rows.select("question_id", empty.alias("empty"), refusal.alias("refusal"), copy.alias("copy"), truncated.alias("truncated"), language.alias("language"))


def defects(rows: DataFrame) -> DataFrame:
    """(question_id, defect_type): one row per question id of ``signs``, the defect null where the pair is sound."""
    found = signs(rows).withColumn("truncated", F.col("truncated").isNotNull())
    return found.select("question_id", F.coalesce(*[F.when(F.col(d), F.lit(d)) for d in DEFECTS]).alias("defect_type"))
