"""Attempt logs that were cut short."""

from lexaudit.operators import fetchlog as FL

LOG = ("target_url string, attempt int, exception_kind string, status_code int, final_url string, "
       "headers array<struct<key:string,value:string>>, body string, history_len int, started_at timestamp_ntz, ended_at timestamp_ntz")


def test_a_log_without_a_final_attempt_gives_an_error_row(spark):
    import datetime as dt
    at = dt.datetime(2024, 1, 1)

    def row(url, attempt, exc, status, done=True):
        return url, attempt, exc, status, url, [], "", 0, at, at + dt.timedelta(seconds=attempt) if done else None

    log = spark.createDataFrame([
        row("whole", 1, None, 503), row("whole", 2, None, 200),
        row("cut", 1, "timeout", None), row("cut", 2, None, 503),
        row("one", 1, "timeout", None),
        row("running", 1, None, 429), row("running", 2, None, None, False)], LOG)
    got = FL.fetch_outcomes(log, 2)
    rows = {r.target_url: (r.outcome, r.error_kind, r.status_code, r.attempts_used) for r in FL.outcome_label(got).collect()}
    assert rows == {"whole": ("success", None, 200, 2), "cut": ("error", "server_error", 503, 2),
                    "one": ("error", "timeout", None, 1), "running": ("error", "request_error", None, 2)}
    assert {r.error_kind: r.n for r in FL.errors_by_kind(got).collect()} == {"server_error": 1, "timeout": 1, "request_error": 1}
