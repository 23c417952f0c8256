"""The stand-in tables once more, as SQL common table expressions for the checks."""

MANIFEST = """
manifest AS (
  SELECT substr(sha256('documents:' || rel), 1, 16) AS sample_id, source AS subject_id,
         lang AS gesture_label, '/data/' || rel AS image_path, rel AS relative_path, doc_id, n_chars
  FROM (SELECT *, source || '/' || lang || '/' || doc_id || '.jpg' AS rel FROM documents)
)"""

MATRIX = """
emb AS (
  SELECT vec_id::VARCHAR AS sample_id, label::VARCHAR AS gesture_label,
         list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
),
geo AS (
  SELECT sample_id, gesture_label, v[2] < -0.2 AS failed, v[2] >= -0.2 AS ok,
         CASE WHEN v[2] < -0.2 THEN list_transform(v, lambda x: 0.0::DOUBLE)
              WHEN NOT v[3] > 0.3 THEN v END AS vec,
         CASE WHEN v[4] <= 0.25 THEN least(1.0::DOUBLE, abs(v[1]) * 4) END AS confidence
  FROM emb
),
geo_valid AS (
  SELECT * FROM geo WHERE ok AND vec IS NOT NULL AND len(list_filter(vec, lambda x: x <> 0)) > 0
),
hog AS (
  SELECT sample_id, gesture_label, v[2] < -0.2 AS failed, list_concat(list_transform(v, lambda x: x * x), [1.0::DOUBLE]) AS vec,
         CASE WHEN v[4] <= 0.25 THEN least(1.0::DOUBLE, abs(v[1]) * 4) END AS confidence
  FROM emb
)"""

LANDMARKS = """
lm AS (
  SELECT vec_id::VARCHAR AS sample_id, label::VARCHAR AS gesture_label,
         list_transform(range(21), lambda i: embedding[i * 3 + 1]::DOUBLE) AS x,
         list_transform(range(21), lambda i: embedding[i * 3 + 2]::DOUBLE) AS y,
         list_transform(range(21), lambda i: embedding[i * 3 + 3]::DOUBLE) AS z,
         abs(embedding[64]::DOUBLE) AS confidence, embedding[64]::DOUBLE < 0.2 AS seen
  FROM embeddings
),
box AS (
  SELECT *, sqrt(power(list_max(x) - list_min(x), 2) + power(list_max(y) - list_min(y), 2)) AS diagonal
  FROM lm WHERE seen
),
norm AS (
  SELECT sample_id, gesture_label,
         list_transform(x, lambda a: (a - x[1]) / CASE WHEN diagonal < 1e-6 THEN 1.0 ELSE diagonal END) AS nx,
         list_transform(y, lambda b: (b - y[1]) / CASE WHEN diagonal < 1e-6 THEN 1.0 ELSE diagonal END) AS ny
  FROM box
)"""

_LOST = "(length(text) - length(replace(text, '{0}', '')))"


def _letters(letters: str) -> str:
    return " + ".join(_LOST.format(x) for x in letters)


PREDICTIONS = f"""
scored AS (
  SELECT doc_id, lang, source, n_chars,
         [({_letters('äöüß')}) + 1, length(text) // 400 + 1, ({_letters('ñáíó')}) + 1,
          ({_letters('éèêç')}) + 1, 1]::DOUBLE[] AS s
  FROM documents
),
pred AS (
  SELECT doc_id::VARCHAR AS sample_id, source AS subject_id,
         CASE WHEN n_chars > 10000 THEN lang || '_long' ELSE lang END AS true_label,
         (['de', 'en', 'es', 'fr', 'none'])[list_position(s, list_max(s))] AS predicted_label,
         list_transform(s, lambda x: x / list_sum(s)) AS probability,
         CASE WHEN n_chars >= 2000 THEN 'ood' ELSE 'in_domain' END AS domain,
         CASE WHEN n_chars >= 500 THEN 'scan' ELSE 'note' END AS context_source,
         list_max(s) / list_sum(s) AS confidence
  FROM scored
)"""

FRAMES = """
frames AS (
  SELECT user_id::VARCHAR AS session_id, event_id AS frame_id, epoch_us(ts) AS us,
         event_type AS label, value / (value + 50.0) AS confidence FROM events
)"""

VOTES = f"""
{FRAMES},
win AS (
  SELECT *, list(label) OVER w AS labels, avg(confidence) OVER w AS avg_confidence
  FROM frames
  WINDOW w AS (PARTITION BY session_id ORDER BY us, frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
),
counted AS (
  SELECT *, list_transform(labels, lambda a: len(list_filter(labels, lambda b: b = a))) AS n FROM win
),
votes AS (
  SELECT session_id, frame_id, us, label, confidence, avg_confidence, len(labels) AS window_size,
         labels[list_position(n, list_max(n))] AS stable_label,
         list_max(n)::DOUBLE / len(labels) AS consensus_ratio
  FROM counted
)"""

ACTIONS = f"""
{VOTES},
marked AS (
  SELECT *, avg_confidence >= 0.4 AND list_contains(['click', 'purchase', 'view', 'signup'], stable_label) AS keyed,
         avg_confidence >= 0.4 AND consensus_ratio >= 0.4 AS eligible,
         CASE stable_label WHEN 'click' THEN 'space' WHEN 'purchase' THEN 'enter'
                           WHEN 'view' THEN 'up' WHEN 'signup' THEN 'up' END AS key
  FROM votes
),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, frame_id) AS rn
  FROM marked WHERE eligible AND key IS NOT NULL
),
fold AS (
  SELECT session_id, frame_id, rn, true AS fired, stable_label AS last_label, us AS last_us FROM cand WHERE rn = 1
  UNION ALL
  SELECT c.session_id, c.frame_id, c.rn,
         NOT (c.stable_label = f.last_label AND c.us - f.last_us < 86400000000),
         c.stable_label,
         CASE WHEN c.stable_label = f.last_label AND c.us - f.last_us < 86400000000 THEN f.last_us ELSE c.us END
  FROM fold f JOIN cand c ON c.session_id = f.session_id AND c.rn = f.rn + 1
),
acts AS (
  SELECT m.session_id, m.frame_id, m.stable_label, m.eligible, m.key, coalesce(f.fired, false) AS would_emit,
         CASE WHEN f.fired THEN 'dry_run' WHEN m.eligible AND m.key IS NULL THEN 'unmapped_gesture'
              ELSE 'not_eligible' END AS reason
  FROM marked m LEFT JOIN fold f ON f.session_id = m.session_id AND f.frame_id = m.frame_id
)"""

RUNS = """
runs AS (
  SELECT l_suppkey || '-' || l_returnflag || '-' || l_linestatus AS run_id, 'EXP-' || l_linestatus AS experiment_id,
         CASE WHEN count(*) >= 90 THEN 'completed' ELSE 'running' END AS status,
         'algo_' || l_returnflag AS algorithm, l_linestatus AS feature_family,
         sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 10) AS accuracy,
         sum(round(l_tax * 100)::BIGINT)::DOUBLE / (count(*) * 8) AS f1_macro,
         sum(round(l_quantity)::BIGINT)::DOUBLE / count(*) AS per_sample_inference_ms
  FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus
)"""


def apportion(prefix: str, rows: str, total: str, seats: str) -> str:
    """CTEs <prefix>_n, <prefix>_q: class sizes of *rows* and their share of *seats*."""
    return f"""
{prefix}_n AS (SELECT gesture_label, count(*)::BIGINT AS n FROM {rows} GROUP BY 1),
{prefix}_f AS (
  SELECT gesture_label, n, (n * {seats}) // {total} AS base, (n * {seats}) % {total} AS rest FROM {prefix}_n
),
{prefix}_q AS (
  SELECT gesture_label, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, gesture_label)
           <= {seats} - sum(base) OVER () THEN 1 ELSE 0 END AS seats
  FROM {prefix}_f
)"""


def split(rows: str) -> str:
    """CTE `split`: the stratified 70/15/15 split of *rows* with seed 42."""
    return f"""
size AS (SELECT count(*)::BIGINT AS n, ceil((1.0::DOUBLE - 0.7::DOUBLE) * count(*))::BIGINT AS h FROM {rows}),
{apportion("a", rows, "(SELECT n FROM size)", "(SELECT h FROM size)")},
first_rank AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.gesture_label ORDER BY sha256('42:' || sample_id), sample_id) - 1 AS r
  FROM {rows} m
),
halves AS (SELECT f.*, f.r >= q.n - q.seats AS held FROM first_rank f JOIN a_q q USING (gesture_label)),
holdout AS (SELECT sample_id, gesture_label FROM halves WHERE held),
tsize AS (
  SELECT h, ceil((1.0::DOUBLE - 0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE)) * h)::BIGINT AS t FROM size
),
{apportion("b", "holdout", "(SELECT h FROM tsize)", "(SELECT t FROM tsize)")},
second_rank AS (
  SELECT *, row_number() OVER (PARTITION BY gesture_label ORDER BY sha256('42:' || sample_id), sample_id) - 1 AS r
  FROM holdout
),
split AS (
  SELECT sample_id, gesture_label, 'train' AS split FROM halves WHERE NOT held
  UNION ALL
  SELECT s.sample_id, s.gesture_label, CASE WHEN s.r >= q.n - q.seats THEN 'test' ELSE 'val' END
  FROM second_rank s JOIN b_q q USING (gesture_label)
)"""


def metrics(pairs: str, listed: str, n_labels: str) -> str:
    """CTEs label_counts, label_scores and a SELECT of all metrics per `grp`.

    *pairs* has (grp, t, y, n); *listed* is a condition on `label` and *n_labels*
    the length of the label list, or NULL for all observed labels.
    """
    return f"""
label_counts AS (
  SELECT grp, label, sum(s) AS s, sum(p) AS p, sum(c) AS c FROM (
    SELECT grp, t AS label, n AS s, 0 AS p, CASE WHEN t = y THEN n ELSE 0 END AS c FROM {pairs}
    UNION ALL SELECT grp, y, 0, n, 0 FROM {pairs}) GROUP BY grp, label
),
label_scores AS (
  SELECT *, ({listed}) AS listed, CASE WHEN p > 0 THEN c::DOUBLE / p ELSE 0 END AS prec,
         CASE WHEN s > 0 THEN c::DOUBLE / s ELSE 0 END AS rec,
         CASE WHEN s + p > 0 THEN 2 * c::DOUBLE / (s + p) ELSE 0 END AS f1
  FROM label_counts
),
scores AS (
  SELECT grp, sum(c)::DOUBLE / sum(s) AS accuracy,
         coalesce(sum(CASE WHEN listed THEN prec END), 0) / coalesce({n_labels}, count(*)) AS precision_macro,
         coalesce(sum(CASE WHEN listed THEN rec END), 0) / coalesce({n_labels}, count(*)) AS recall_macro,
         coalesce(sum(CASE WHEN listed THEN f1 END), 0) / coalesce({n_labels}, count(*)) AS f1_macro,
         coalesce(sum(CASE WHEN listed THEN c END)::DOUBLE / nullif(sum(CASE WHEN listed THEN p END), 0), 0) AS precision_micro,
         coalesce(sum(CASE WHEN listed THEN c END)::DOUBLE / nullif(sum(CASE WHEN listed THEN s END), 0), 0) AS recall_micro,
         coalesce(2 * sum(CASE WHEN listed THEN c END)::DOUBLE
                  / nullif(sum(CASE WHEN listed THEN s + p END), 0), 0) AS f1_micro,
         sum(s)::BIGINT AS n_samples
  FROM label_scores GROUP BY grp
)"""


def rounded(*columns: str) -> str:
    """Columns rounded to six digits under their own names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


SCORES = (
    "accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_micro", "recall_micro", "f1_micro",
)
