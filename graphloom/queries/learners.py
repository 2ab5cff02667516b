"""Learner state, quizzes and recommendations.  Events are answers: user_id learns event_type, right where value >= 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import learner as L
from ..operators import concepts as C
from ..operators import graph as G
from ..operators import learner as O
from . import graphs, query, read

_A = "a as (select user_id as student, event_type as concept, list(value >= 50 order by ts, event_id) as answers, count(*) as attempts, count(*) filter (where value >= 50) as correct_attempts from events group by all)"
_BKT = "greatest(0.01, least(0.99, (case when x then p * 0.9 / (p * 0.9 + (1 - p) * 0.25) else p * 0.1 / (p * 0.1 + (1 - p) * 0.75) end) * 0.9 + 0.1))"
_LINEAR = "greatest(0.1, least(1.0, p + case when x then 0.15 else -0.10 end))"


def _fold(step: str) -> str:
    """One step a row of a recursive table: the answers in order."""
    body = step.replace("x then", "answers[k + 1] then")
    return f"walk as (select student, concept, attempts, correct_attempts, answers, 0 as k, 0.3::double as p from a union all select student, concept, attempts, correct_attempts, answers, k + 1, {body} from walk where k < attempts)"


_STATE = f"{_A}, {_fold(_BKT)}, state as (select student, concept, greatest(0.1, least(1.0, p)) as mastery_level, p as p_known, attempts, correct_attempts from walk where k = attempts)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("right", F.col("value") >= 50)
    return O.answers(events, "user_id", "event_type", "right", ["ts", "event_id"])


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mastery(history(spark, sf_dir))


@query(f"with recursive {_STATE} select student, concept, round(mastery_level, 6) as mastery_level, round(p_known, 6) as p_known, attempts, correct_attempts from state")
def bkt_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir).select("student", "concept", F.round("mastery_level", 6).alias("mastery_level"), F.round("p_known", 6).alias("p_known"), "attempts", "correct_attempts")


@query(f"with recursive {_A}, {_fold(_LINEAR)} select student, concept, round(p, 6) as mastery_level from walk where k = attempts")
def linear_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mastery(history(spark, sf_dir), "linear").select("student", "concept", F.round("mastery_level", 6).alias("mastery_level"))


@query(f"with recursive {_A}, {_fold(_BKT)} select student, concept, k as attempt, round(p, 6) as p_known from walk where k > 0")
def mastery_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mastery_trace(history(spark, sf_dir)).withColumn("p_known", F.round("p_known", 6))


@query(f"with recursive {_STATE} select student, round(avg(mastery_level), 6) as overall_ability, count(*) as concepts from state group by student")
def overall_ability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overall_ability(state(spark, sf_dir)).withColumn("overall_ability", F.round("overall_ability", 6))


@query(f"with recursive {_STATE} select student, concept, case when mastery_level < 0.4 then 'easy' when mastery_level <= 0.7 then 'medium' else 'hard' end as difficulty, case when mastery_level >= 0.7 then 'complete' when mastery_level >= 0.3 then 'current' else 'pending' end as status from state")
def target_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mastery_level")
    return state(spark, sf_dir).select("student", "concept", L.target_difficulty(m).alias("difficulty"), L.learning_status(m).alias("status"))


@query(f"with recursive {_STATE} select student, count(*) filter (where mastery_level >= 0.7) as mastered, count(*) filter (where mastery_level >= 0.3 and mastery_level < 0.7) as in_progress, round(avg(mastery_level), 6) as mean from state group by student")
def mastery_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rollup(state(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("select user_id as student, event_type as concept, round(avg((value >= 50)::integer), 6) as accuracy from events group by all")
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.accuracy(state(spark, sf_dir)).select("student", "concept", F.round("accuracy", 6).alias("accuracy"))


@query(f"with recursive {_STATE} select w.student, w.concept, round(coalesce(s.mastery_level, 0.3), 3) as mastery_level from (select student, concept from (select distinct user_id as student from events), (select distinct event_type as concept from events union select 'unseen')) w left join state s using (student, concept)")
def mastery_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kinds = [r.event_type for r in events.select("event_type").distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("too many concepts to look each up for every student")
    wanted = events.select(F.col("user_id").alias("student")).distinct().withColumn("concept", F.explode(F.array(*map(F.lit, {*kinds, "unseen"}))))
    return O.lookup(wanted, state(spark, sf_dir))


_R = "r as (select user_id as quiz, event_type as concept, value >= 50 as correct, event_id as place from events)"
_G = "g as (select quiz, round(avg(correct::integer) * 100, 1) as score_pct from r group by quiz)"
_PATH = "case when score_pct < 50 then 'remediation' when score_pct > 80 then 'advancement' else 'mixed' end"
_W = "w as (select quiz, coalesce(list(concept order by first, concept) filter (where not correct), []) as weak, coalesce(list(concept order by first, concept) filter (where correct), []) as strong from (select quiz, concept, correct, min(place) as first from r group by all) group by quiz)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("quiz"), F.col("event_type").alias("concept"), (F.col("value") >= 50).alias("correct"), F.col("event_id").alias("place"))


@query(f"with {_R}, {_G} select quiz, score_pct, {_PATH} as path_type from g")
def quiz_path_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.grade(results(spark, sf_dir), "quiz")


@query(f"with {_R}, {_W} select quiz, array_to_string(weak, ',') as weak, array_to_string(strong, ',') as strong from w")
def weak_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.weak_and_strong(results(spark, sf_dir), "quiz", "place").select("quiz", F.array_join("weak", ",").alias("weak"), F.array_join("strong", ",").alias("strong"))


@query(
    f"""with {_R}, {_G}, {_W}, j as (select g.quiz, printf('%.0f', score_pct) as s, {_PATH} as path, weak, strong from g join w using (quiz))
select quiz, case path when 'remediation' then 'You scored ' || s || '%. We recommend reviewing ' || coalesce(nullif(array_to_string(weak[1:3], ', '), ''), 'the quiz topics') || ' and their prerequisites before moving on.'
  when 'advancement' then 'Excellent! You scored ' || s || '%. You''ve demonstrated strong mastery of ' || coalesce(nullif(array_to_string(strong[1:3], ', '), ''), 'the quiz topics') || '. Explore the advanced topics below to deepen your understanding.'
  else 'You scored ' || s || '%. You''re doing well on ' || coalesce(nullif(array_to_string(strong[1:2], ', '), ''), 'other areas') || ', but could strengthen ' || coalesce(nullif(array_to_string(weak[1:2], ', '), ''), 'some areas') || '. See targeted recommendations below.' end as summary from j"""
)
def recommendation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = O.grade(results(spark, sf_dir), "quiz").join(O.weak_and_strong(results(spark, sf_dir), "quiz", "place"), "quiz")
    return joined.select("quiz", L.summary(F.col("path_type"), F.col("score_pct"), F.col("weak"), F.col("strong")).alias("summary"))


_RELATED_STARTS = "starts as (select distinct target as name from pre union select distinct source from rel)"


@query(
    f"with {graphs._E}, {_RELATED_STARTS}, p as (select distinct s.name as start, p.source as node from starts s join pre p on p.target = s.name), q as (select distinct s.name as start, case when r.source = s.name then r.target else r.source end as node from starts s join rel r on s.name in (r.source, r.target)), found as (select * from p union all select * from q where start not in (select start from p)) {graphs._NEIGHBORS.format(k=5)}"
)
def recommend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = graphs.edges(spark, sf_dir), graphs.nodes(spark, sf_dir)
    starts = e.where("type = 'PREREQ'").select(F.col("target").alias("name")).union(e.where("type = 'RELATED'").select(F.col("source").alias("name"))).distinct()
    found = O.with_fallback(G.direct(e, n, starts, "prerequisites"), G.direct(e, n, starts, "related"))
    return found.withColumn("importance", F.round("importance", 6))


_K = "json_extract_string(props, '$.k')::double / 100"


@query(f"select event_id, case when {_K} < 0.35 then 'easy' when {_K} < 0.65 then 'medium' else 'hard' end as label, case lower(trim(event_type)) when 'easy' then 0.25 when 'hard' then 0.75 else 0.5 end::double as score, case when {_K} >= 0.7 then 'high' when {_K} >= 0.4 then 'middle' else 'low' end as band from events")
def difficulty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return read(spark, sf_dir, "events").select("event_id", L.difficulty_label(k).alias("label"), L.difficulty_score(F.col("event_type")).alias("score"), L.result_band(k).alias("band"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model with one question: every third without a score, every fifth without a fence, some broken."""
    e = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    score = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.format_string(', "difficulty_score": %.2f', F.col("k") / 100))
    name = F.element_at(F.array(F.lit("easy"), F.lit("Hard"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"questions": [{"text": "q", "options": [{"id": "a", "text": "A"}, {"id": "b", "text": "B"}], "correct_option_id": "b", "explanation": "e", "difficulty": "'), name, F.lit('"'), score, F.lit("}]}"))
    text = F.when(F.col("event_id") % 7 == 0, "no json").when(F.col("event_id") % 5 == 0, body).when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))
    return e.select("event_id", text.alias("text"))


_Q = f"q as (select event_id as quiz_id, case when event_id % 3 = 0 then 0.25 else round({_K}, 2) end::double as difficulty_score from events where event_id % 7 <> 0)"


@query(f"with {_Q} select quiz_id, 0 as place, 'q' as text, 2 as n_options, 'b' as correct_option_id, case when difficulty_score < 0.35 then 'easy' when difficulty_score < 0.65 then 'medium' else 'hard' end as difficulty, difficulty_score from q")
def quiz_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parse_quiz(replies(spark, sf_dir), "event_id", "text")


@query(f"with {_Q} select quiz_id % 100 as quiz_group, round(avg(difficulty_score), 6) as average_difficulty from q group by 1")
def quiz_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = O.parse_quiz(replies(spark, sf_dir), "event_id", "text").withColumn("quiz_group", F.col("quiz_id") % 100)
    return questions.groupBy("quiz_group").agg(F.round(F.avg("difficulty_score"), 6).alias("average_difficulty"))


@query("select c_custkey as student_id, case when c_custkey % 10 = 0 then 0.3 else c_acctbal end::double as ability from customer")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_acctbal").alias("ability"))
    new = old.where("student_id % 10 = 0").withColumn("ability", F.lit(0.3))
    return O.merge_profiles(old, new)


@query(f"with recursive {_STATE} select student, case when student = 1 then 0.3 else round(avg(mastery_level), 6) end as overall_ability, case when student = 1 then 0 else count(*) end as concepts from state group by student")
def profile_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with one learner's put back to the default."""
    return O.reset(O.profiles(state(spark, sf_dir)), 1).withColumn("overall_ability", F.round("overall_ability", 6))


@query("select student, concept from (select *, row_number() over (partition by student order by concept) as place from (select distinct user_id as student, event_type as concept from events)) where place <= 6")
def progress_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_entries(state(spark, sf_dir)).select("student", "concept")


@query("with m as (select user_id as start, event_type as name from events where value >= 100), f as (select user_id as start, event_type as name from events where value < 100) select start, name, count(*) as n from (select * from m union all select * from f where start not in (select start from m)) group by all")
def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("start"), F.col("event_type").alias("name"), "value")
    return C.first_non_empty(e.where("value >= 100").drop("value"), e.where("value < 100").drop("value"), "start").groupBy("start", "name").agg(F.count(F.lit(1)).alias("n"))
