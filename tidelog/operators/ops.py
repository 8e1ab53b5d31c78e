"""Operational analytics: audit, limits, lockouts, access, sessions, latency, exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.folds import ordered_fold


def latest(audit: DataFrame, n: int = 1000, **where: str) -> DataFrame:
    """The latest n events, of a type or user if given; ties by id. Each task keeps n rows."""
    for c, v in where.items():
        audit = audit.where(F.col(c) == v)
    return audit.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


def audit_stats(audit: DataFrame) -> DataFrame:
    return audit.groupBy("event_type").agg(F.count("*").alias("events"))


def counters(rows: DataFrame, kinds: dict[str, Column], sums: dict[str, tuple[str, Column]], by: str = "topic") -> DataFrame:
    """(by, counters): rows of each kind, and sums over rows of a kind; one aggregate, partial before its shuffle."""
    counted = [F.count_if(when).alias(name) for name, when in kinds.items()]
    summed = [F.coalesce(F.sum(F.when(kinds[kind], value)), F.lit(0)).cast("long").alias(name) for name, (kind, value) in sums.items()]
    return rows.groupBy(by).agg(*counted, *summed)


def retained(audit: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    return audit.where(F.col("timestamp") >= now_ms - keep_ms)


def iso8601(ms: Column) -> Column:
    """Milliseconds since 1970 as a UTC time with milliseconds, whatever the session's time zone."""
    days, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    part = lambda by, of, width: F.lpad(F.pmod(F.floor(rest / by), F.lit(of)).cast("string"), width, "0")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    return F.concat(day, F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> None:
    """Append the column `line` as text files, in a folder for each value of `by` if it is given."""
    out = lines.select("line", *([by] if by else [])).write.mode("append")
    (out.partitionBy(by) if by else out).text(path)


def json_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def rotate(lines: DataFrame, budget: int, day: str = "day") -> DataFrame:
    """The most recent lines of each file (day) whose bytes, newlines included, fit the budget."""
    newer = W.partitionBy(day).orderBy(F.desc("timestamp"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("run", F.sum(F.octet_length("line") + 1).over(newer)).where(F.col("run") <= budget).drop("run")


def top_blocked(blocked: DataFrame, n: int) -> DataFrame:
    """(action, identifier, blocked): the n most blocked of each action; counted before they are ranked."""
    c = blocked.groupBy("action", "identifier").agg(F.count("*").alias("blocked"))
    k = F.row_number().over(W.partitionBy("action").orderBy(F.desc("blocked"), "identifier"))
    return c.withColumn("place", k.cast("long")).where(F.col("place") <= n)


def per_ip(connections: DataFrame) -> DataFrame:
    return connections.groupBy("ip").agg(F.count("*").alias("connections"))


def connections_of(connections: DataFrame, topic: str) -> DataFrame:
    return connections.where(F.col("topic") == topic).orderBy(F.desc("opened_ms"), F.desc("connection_id"))


def acl_matches(kind: Column, resource: Column, topic: Column) -> Column:
    return ((kind == "literal") & (resource == topic)) | ((kind == "prefix") & F.startswith(topic, resource))


def authorize(requests: DataFrame, users: DataFrame, acl: DataFrame, strict: bool) -> DataFrame:
    """requests (username, operation, topic) with allowed and why: admin, a global permission unless strict, a grant.

    Grants meet requests by user and operation; their patterns are tried within these.
    """
    g = acl.select(F.col("username").alias("g_user"), F.col("operation").alias("g_op"), "kind", "resource")
    hit = requests.join(g, (F.col("username") == F.col("g_user")) & (F.col("operation") == F.col("g_op")) & acl_matches(F.col("kind"), F.col("resource"), F.col("topic")), "left_semi").select(*requests.columns).distinct().withColumn("granted", F.lit(True))
    met = requests.join(users, "username", "left").join(hit, requests.columns, "left")
    why = F.when(F.coalesce("admin", F.lit(False)), "admin").when(F.lit(not strict) & F.array_contains(F.coalesce("permissions", F.array().cast("array<string>")), F.col("operation")), "global").when(F.col("granted"), "grant").otherwise("denied")
    return met.select(*requests.columns, why.alias("why"), (why != "denied").alias("allowed"))


def grants(changes: DataFrame) -> DataFrame:
    """Grants that stand after (seq, op grant or revoke, username, operation, kind, resource): the last change of each decides."""
    key = ["username", "operation", "kind", "resource"]
    return changes.groupBy(*key).agg(F.max_by("op", "seq").alias("op")).where("op = 'grant'").select(*key)


def _since_success(attempts: DataFrame) -> DataFrame:
    """attempts (username, ip, ts, seq, ok) with fails: failures since the last success, itself included."""
    w = W.partitionBy("username", "ip").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = attempts.withColumn("_g", F.sum(F.col("ok").cast("long")).over(w))
    inner = W.partitionBy("username", "ip", "_g").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return run.withColumn("fails", F.sum((~F.col("ok")).cast("long")).over(inner)).drop("_g")


def failed_attempts(attempts: DataFrame) -> DataFrame:
    """(username, ip, fails): failures since the last success, where there are any."""
    last = _since_success(attempts).groupBy("username", "ip").agg(F.max_by("fails", "seq").alias("fails"))
    return last.where("fails > 0")


# fixed values: the factors of a lockout's duration at 1, 2, 3, 4 and more times the allowed attempts
FACTORS = (1, 3, 9, 24, 72)


def lockouts(attempts: DataFrame, most: int, base_ms: int) -> DataFrame:
    """Every failure that locks: (username, ip, seq, fails, duration_ms, locked_until)."""
    step = F.least(F.expr(f"fails div {most}"), F.lit(len(FACTORS))).cast("int")
    d = F.element_at(F.array(*[F.lit(f) for f in FACTORS]), step).cast("long") * base_ms
    hit = _since_success(attempts).where((F.col("fails") >= most) & ~F.col("ok"))
    return hit.select("username", "ip", "seq", "fails", d.alias("duration_ms"), (F.col("ts") + d).alias("locked_until"))


def locked(attempts: DataFrame, most: int, base_ms: int, now_ms: int) -> DataFrame:
    """(username, ip, remaining_ms) of accounts that are locked now: no success since, and not yet over."""
    state = _since_success(attempts).groupBy("username", "ip").agg(F.max("seq").alias("seq"))
    last = lockouts(attempts, most, base_ms).join(state, ["username", "ip", "seq"])
    return last.where(F.col("locked_until") > now_ms).select("username", "ip", (F.col("locked_until") - now_ms).alias("remaining_ms"))


def session_status(checks: DataFrame, sessions: DataFrame, now_s: int, bind_agent: bool = False) -> DataFrame:
    """checks (check_id, token, ip) against sessions (token, username, ip, expires_at): status, and the audit events it emits.

    Expiry is reported before a foreign address, which is recorded all the same; so one check may emit two events. With
    bind_agent both tables have an `agent`, and another one than the session's counts as a foreign address does.
    """
    s = sessions.select("token", "username", F.col("ip").alias("s_ip"), "expires_at", *([F.col("agent").alias("s_agent")] if bind_agent else []))
    gone, odd = F.col("expires_at") < now_s, F.col("ip") != F.col("s_ip")
    if bind_agent:
        odd = odd | ~F.col("agent").eqNullSafe(F.col("s_agent")) & F.col("s_ip").isNotNull()
    status = F.when(F.col("s_ip").isNull(), "invalid_session").when(gone, "session_expired").when(odd, "session_hijack_attempt").otherwise("ok")
    m = checks.join(s, "token", "left")
    return m.select("check_id", status.alias("status"), F.coalesce(odd, F.lit(False)).cast("long").alias("hijack_events"), F.coalesce(gone, F.lit(False)).cast("long").alias("expired_events"))


def sessions_after(changes: DataFrame, timeout_s: int) -> DataFrame:
    """(token, username, ip, agent, expires_at) that stand after changes (seq, op create or revoke, token, username, ip, agent, now): the last change of a token decides."""
    last = changes.groupBy("token").agg(F.max_by(F.struct("op", "username", "ip", "agent", "now"), "seq").alias("c")).where("c.op = 'create'")
    return last.select("token", "c.username", "c.ip", "c.agent", (F.col("c.now") + timeout_s).alias("expires_at"))


def user_answers(changes: DataFrame) -> DataFrame:
    """changes (seq, op put, password or delete, username, secret, now) with the answer of each and the user's state after it.

    put of a user that exists is refused, so is a password for one that does not; deleting an absent user is no error.
    Whether a user exists before a change follows from the put or delete before it, so no fold is needed.
    """
    w = W.partitionBy("username").orderBy("seq")
    before = F.last(F.when(F.col("op") != "password", F.col("op")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = changes.withColumn("_there", F.coalesce(before == "put", F.lit(False)))
    answer = F.when((F.col("op") == "put") & F.col("_there"), "user_exists").when((F.col("op") == "password") & ~F.col("_there"), "user_not_found").otherwise("ok")
    return rows.withColumn("answer", answer).withColumn("exists_after", F.when(F.col("op") == "put", True).when(F.col("op") == "delete", False).otherwise(F.col("_there"))).drop("_there")


def users_after(changes: DataFrame) -> DataFrame:
    """(username, secret, created, updated) of the users that stand after changes, as user_answers() takes them."""
    done = user_answers(changes).where("answer = 'ok'")
    first = F.max(F.when(F.col("op") == "put", F.col("seq"))).over(W.partitionBy("username"))
    life = done.withColumn("_put", first).where(F.col("seq") >= F.col("_put"))
    kept = life.groupBy("username").agg(F.max_by("op", "seq").alias("op"), F.max_by("secret", "seq").alias("secret"), F.min("now").alias("created"), F.max_by("now", "seq").alias("updated"))
    return kept.where("op <> 'delete'").drop("op")


def active_sessions(sessions: DataFrame, now_s: int) -> DataFrame:
    return sessions.where(F.col("expires_at") >= now_s)


def import_users(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming users that do not exist yet; of several of one name, the first by seq."""
    first = incoming.groupBy("username").agg(F.min_by("role", "seq").alias("role"))
    return first.join(existing.select("username"), "username", "left_anti")


def percentiles(samples: DataFrame, by: str, value: str, points: tuple[int, ...] = (50, 95, 99), rule: str = "ceil") -> DataFrame:
    """Exact percentiles that are samples: nearest rank (ceil), or round(p / 100 * (n - 1)) for rule 'round'.

    Values are counted first; a rank is then found in running counts, so no group's samples are gathered.
    """
    c = samples.groupBy(by, value).agg(F.count("*").alias("_c"))
    run = c.withColumn("_r", F.sum("_c").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = run.withColumn("_n", F.sum("_c").over(W.partitionBy(by)))
    rank = (lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_n") / 100), F.lit(1))) if rule == "ceil" else (lambda p: F.floor(F.lit(p) * (F.col("_n") - 1) / 100 + 0.5) + 1)
    return run.groupBy(by).agg(*[F.min(F.when(F.col("_r") >= rank(p), F.col(value))).alias(f"p{p}") for p in points])


def history(events: DataFrame, now_ms: int, seconds: int) -> DataFrame:
    """(second, events) of the last `seconds` seconds that have any."""
    return events.where(F.col("timestamp") > now_ms - 1000 * seconds).groupBy(F.expr("timestamp div 1000").alias("second")).agg(F.count("*").alias("events"))


def label(text: Column) -> Column:
    """A label value with backslash, quote and newline escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(topics: DataFrame, metrics: list[tuple[str, str, str, str]]) -> DataFrame:
    """(ord, line): the text format of metrics (name, kind, help, column), a sample a topic, in order."""
    heads = [(f"{k:04d}", "0", f"# HELP {n} {h}\n# TYPE {n} {kind}") for k, (n, kind, h, _) in enumerate(metrics)]
    out = topics.sparkSession.createDataFrame(heads, "a string, b string, line string")
    for k, (n, _, _, c) in enumerate(metrics):
        out = out.unionByName(topics.select(F.lit(f"{k:04d}").alias("a"), F.concat(F.lit("1"), "topic").alias("b"), F.concat(F.lit(n + '{topic="'), label(F.col("topic")), F.lit('"} '), F.col(c).cast("string")).alias("line")))
    return out.select(F.concat_ws("/", "a", "b").alias("ord"), "line")


def bucket_step(limit: int, window_ms: int):
    """One request against a lazily refilled bucket: state (tokens, last, start), answer (allowed, retry_after_ms).

    The refill is cut to whole tokens and an allowed request forgets the rest; a refused one changes nothing.
    """

    def step(state: tuple[int, int, int] | None, now: int):
        if state is None:
            return (limit - 1, now, now), (True, 0)
        tokens, last, start = state
        more = limit if now - last >= window_ms else int((now - last) * limit / window_ms)
        have = min(limit, tokens + more)
        if have > 0:
            return (have - 1, now, now if more > 0 else start), (True, 0)
        return state, (False, max(0, start + window_ms - now))

    return step


def token_bucket(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """requests (identifier, action, seq, ts) with allowed and retry_after_ms. An outcome depends on every request before it."""
    one = bucket_step(limit, window_ms)

    def step(state, seq: int, now: int):
        state, answer = one(state, now)
        return state, (seq, *answer)

    return ordered_fold(requests, ("identifier", "action"), ("seq",), ("seq", "ts"), lambda: None, step, "identifier string, action string, seq long, allowed boolean, retry_after_ms long")


def lease_fold(commands: DataFrame) -> DataFrame:
    """commands (lease, seq, op acquire or release, candidate, fence, duration_ms, now) with the answer and the state after each."""

    def step(state, seq, op, candidate, fence, duration_ms, now):
        holder, token, until = state
        answer = "ok"
        if op == "acquire":
            if holder is None or holder == candidate or now >= until:
                holder, token, until = candidate, token + (holder != candidate), now + duration_ms
                answer = f"ok {token}"
            else:
                answer = f"held {holder}"
        elif holder == candidate and token == fence:
            holder = None
        return (holder, token, until), (seq, answer, holder, token)

    return ordered_fold(commands, ("lease",), ("seq",), ("seq", "op", "candidate", "fence", "duration_ms", "now"), lambda: (None, 0, 0), step, "lease string, seq long, answer string, holder string, fence_now long")


def reservoir(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows by the smallest hashes of (seed, row): the same rows give the same sample, and each task keeps k rows."""
    return samples.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in samples.columns]))).limit(k)


def extremes(samples: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, least, most): the exact count, minimum and maximum that go with a sample."""
    return samples.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
