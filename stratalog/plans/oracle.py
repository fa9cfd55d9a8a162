"""The SQL that each query of catalogue.py must equal, for any engine that has the base tables."""

VIEWS = {
    "kv": """SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS entry_type, concat('user::', lpad(cast(user_id as string),6,'0')) AS k, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v, cast(CASE WHEN event_type = 'error' THEN 0 ELSE length(props) END as bigint) AS value_size, cast(floor(event_id / 1000) as int) AS file_id, ts FROM events""",
    "kvm": """SELECT event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 2 ELSE 1 END AS entry_type, CASE WHEN event_type IN ('signup','purchase') THEN NULL ELSE concat('user::', lpad(cast(user_id as string),6,'0')) END AS k, CASE WHEN event_type IN ('view','click') THEN props END AS v, cast(floor(event_id / 1000) as int) AS file_id FROM events""",
    "kv_live": """SELECT *, CASE WHEN entry_type = 1 AND row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1 THEN 1 ELSE 0 END AS live FROM kv""",
    "keydir": """SELECT seq, k, v, value_size, file_id FROM kv_live WHERE live = 1""",
}

STATEMENTS = {
    "keydir_fold": """SELECT k, seq, file_id, value_size FROM keydir""",
    "get_point": """SELECT k, v FROM keydir WHERE k = 'user::000042'""",
    "multi_get": """SELECT p.k, d.v FROM (SELECT concat('user::', lpad(cast(c_custkey as string),6,'0')) k FROM customer) p JOIN keydir d ON p.k = d.k""",
    "contains_key": """SELECT p.k, CASE WHEN d.k IS NULL THEN 0 ELSE 1 END AS found FROM (SELECT concat('user::', lpad(cast(c_custkey as string),6,'0')) k FROM customer) p LEFT JOIN keydir d ON p.k = d.k""",
    "iter_from": """SELECT k, v FROM keydir WHERE k >= 'user::000040' ORDER BY k""",
    "iter_from_limit50": """SELECT k, v FROM keydir WHERE k >= 'user::000040' ORDER BY k LIMIT 50""",
    "keys_from_prefix": """SELECT k FROM keydir WHERE k >= 'user::0001' AND k < 'user::0002' ORDER BY k""",
    "riter_from_limit10": """SELECT k, v FROM keydir WHERE k <= 'user::0001zz' ORDER BY k DESC LIMIT 10""",
    "rkeys_from_all": """SELECT k FROM keydir ORDER BY k DESC""",
    "range50_per_start": """WITH x AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM keydir) SELECT a.k AS start_key, b.k AS k, cast(b.i - a.i as int) AS pos FROM x a JOIN x b ON b.i >= a.i AND b.i < a.i + 50""",
    "lower_bound": """SELECT p.k AS probe, min(d.k) AS lb FROM (SELECT concat('user::', lpad(cast(s_suppkey*2 as string),6,'0')) k FROM supplier) p LEFT JOIN keydir d ON d.k >= p.k GROUP BY p.k""",
    "upper_bound": """SELECT p.k AS probe, min(d.k) AS ub FROM (SELECT concat('user::', lpad(cast(s_suppkey*2 as string),6,'0')) k FROM supplier) p LEFT JOIN keydir d ON d.k > p.k GROUP BY p.k""",
    "tombstone_map": """SELECT k, max(seq) AS tomb_seq FROM kv WHERE entry_type = 2 GROUP BY k""",
    "hint_dedup_per_file": """SELECT file_id, k, seq, entry_type, value_size FROM (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY seq DESC) rn FROM kv) t WHERE rn = 1""",
    "recovery_merge_from_hints": """SELECT k, seq, file_id, value_size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r2 FROM (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY seq DESC) rn FROM kv) t WHERE rn = 1) u WHERE r2 = 1 AND entry_type = 1""",
    "upsert_newer": """WITH s AS (SELECT k, seq, value_size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9000) t WHERE rn = 1 AND entry_type = 1) SELECT coalesce(s.k, c.k) AS k, CASE WHEN s.k IS NULL OR c.seq > s.seq THEN c.seq ELSE s.seq END AS seq, CASE WHEN s.k IS NULL OR c.seq > s.seq THEN c.value_size ELSE s.value_size END AS value_size FROM s FULL OUTER JOIN keydir c ON s.k = c.k""",
    "merge_resolved": """SELECT k, max(seq) AS seq, max(value_size) AS value_size FROM (SELECT * FROM (SELECT k, seq, value_size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9000) t WHERE rn = 1 AND entry_type = 1) a UNION ALL SELECT * FROM (SELECT k, seq, value_size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9950) t WHERE rn = 1 AND entry_type = 1) b) u GROUP BY k""",
    "live_size": """SELECT count(*) AS size, count(*) = 0 AS is_empty FROM keydir""",
    "next_lsn": """SELECT cast(max(seq) + 1 as bigint) AS next_lsn FROM kv""",
    "file_stats": """SELECT file_id, cast(sum(live * (19 + length(k) + value_size)) as bigint) AS live_bytes, cast(sum(19 + length(k) + value_size) as bigint) AS total_bytes FROM kv_live GROUP BY file_id""",
    "vacuum_candidate": """WITH fs AS (SELECT file_id, sum(live * (19 + length(k) + value_size)) AS l, sum(19 + length(k) + value_size) AS t FROM kv_live GROUP BY file_id) SELECT file_id FROM fs WHERE file_id < 9 AND 1.0 - cast(l as double)/cast(t as double) > 0.5 ORDER BY 1.0 - cast(l as double)/cast(t as double) DESC, file_id LIMIT 1""",
    "vacuum_compact_output": """SELECT seq, k, entry_type, value_size FROM kv_live WHERE file_id = 8 AND (live = 1 OR entry_type = 2)""",
    "batch_aware_scan": """SELECT seq, k, entry_type FROM (SELECT *, max(CASE WHEN entry_type IN (3,4) THEN seq*10+entry_type END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm, min(CASE WHEN entry_type IN (3,4) THEN seq*10+entry_type END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nm FROM kvm) t WHERE entry_type IN (1,2) AND (pm IS NULL OR pm % 10 = 4 OR nm % 10 = 4)""",
    "batch_fold": """WITH c AS (SELECT seq, k, entry_type FROM (SELECT *, max(CASE WHEN entry_type IN (3,4) THEN seq*10+entry_type END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm, min(CASE WHEN entry_type IN (3,4) THEN seq*10+entry_type END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nm FROM kvm) t WHERE entry_type IN (1,2) AND (pm IS NULL OR pm % 10 = 4 OR nm % 10 = 4)) SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM c) d WHERE rn = 1 AND entry_type = 1""",
    "snapshot_as_of": """SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9000) t WHERE rn = 1 AND entry_type = 1""",
    "range_guard_conflicts": """WITH s AS (SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9950) t WHERE rn = 1 AND entry_type = 1) SELECT coalesce(c.k, s.k) AS k, coalesce(s.seq, 0) AS snap_seq, coalesce(c.seq, 0) AS cur_seq FROM s FULL OUTER JOIN keydir c ON s.k = c.k WHERE coalesce(c.k, s.k) >= 'user::000010' AND coalesce(c.k, s.k) < 'user::000050' AND coalesce(s.seq, 0) <> coalesce(c.seq, 0)""",
    "point_guard_verdicts": """WITH s AS (SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9950) t WHERE rn = 1 AND entry_type = 1), p AS (SELECT concat('user::', lpad(cast(c_custkey as string),6,'0')) k, cast(c_custkey % 4 as int) AS g FROM customer) SELECT p.k, p.g, CASE WHEN g = 1 AND c.k IS NULL THEN 0 WHEN g = 2 AND c.k IS NOT NULL THEN 0 WHEN g = 3 AND coalesce(c.seq,0) <> coalesce(s.seq,0) THEN 0 ELSE 1 END AS ok FROM p LEFT JOIN keydir c ON c.k = p.k LEFT JOIN s ON s.k = p.k""",
    "ww_conflicts": """WITH s AS (SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv WHERE seq <= 9950) t WHERE rn = 1 AND entry_type = 1), p AS (SELECT concat('user::', lpad(cast(c_custkey as string),6,'0')) k FROM customer) SELECT p.k, CASE WHEN s.k IS NULL THEN 'appeared' WHEN c.k IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM p LEFT JOIN keydir c ON c.k = p.k LEFT JOIN s ON s.k = p.k WHERE coalesce(c.seq,0) <> coalesce(s.seq,0)""",
    "txn_merge_iter": """WITH w AS (SELECT concat('user::', lpad(cast(s_suppkey*3 as string),6,'0')) AS k, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS v FROM supplier) SELECT coalesce(w.k, d.k) AS k, CASE WHEN w.k IS NOT NULL THEN w.v ELSE d.v END AS v FROM keydir d FULL OUTER JOIN w ON w.k = d.k WHERE NOT (w.k IS NOT NULL AND w.v IS NULL)""",
    "hint_prefix_len": """WITH h AS (SELECT k, lag(k) OVER (ORDER BY k) AS pk FROM keydir), n AS (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS t(i)) SELECT h.k, max(n.i) AS prefix_len FROM h JOIN n ON n.i <= length(h.k) AND substring(h.k,1,n.i) = substring(coalesce(h.pk,''),1,n.i) GROUP BY h.k""",
    "table_prefix_scan": """WITH enc AS (SELECT concat('t00000001', lpad(cast(c_custkey as string),10,'0')) AS k, c_name AS v FROM customer UNION ALL SELECT concat('t00000002', lpad(cast(s_suppkey as string),10,'0')), s_name FROM supplier) SELECT cast(substring(k,10,10) as bigint) AS pk, v FROM enc WHERE k >= 't00000002' AND k < 't00000003'""",
}


def oracle_sql() -> dict[str, str]:
    views = ", ".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())
    return {name: f"WITH {views} SELECT * FROM ({sql}) q" for name, sql in STATEMENTS.items()}
