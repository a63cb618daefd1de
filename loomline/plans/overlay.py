"""A signal overlay: synthetic session lines over real rows of ``events``.

The supplied texts hold none of the words that transcript rules look for, so each event is given a
role and a sentence: its type says who speaks, and the whole part of its value says what. A
session is a user's third of a month. The select runs as it stands in Spark and in DuckDB.
"""

from __future__ import annotations

SAID = {
    "user_message": ["please fix the login page", "hello", "always run the tests before pushing", "update the parser for this module", "what is 2+2?", "review the retry logic in src/app"],
    "view": [
        "We decided to use parquet for the table",
        "I'll check the config now",
        "Next step: wire up the cache",
        "The comparison of both parsers took a while",
        "Nothing to report",
        "Tried to patch the loader but gave up on it",
        "Recommended option for now, summary is final",
        "We still need to rename the module",
    ],
    "purchase": ["Fixed the parser in the core module", "Resolved the timeout and all checks passed", "Verified with `npm test` twice", "Root cause was a missing index", "Build succeeded; the failure in the logs is gone"],
    "tool_use_stub": ["npm test", "git status", "git", "./scripts/qa", "cargo test   --lib", "td-1a2b3c", "python3 -m pytest tests/unit", "ls", "just decide"],
    "tool_result_stub": ["Build failed with ENOENT", "EXPECTED EPIPE, then EACCES", "TypeError: x is undefined", "process ended with exit code", "request timed out", "EXPECTED value found"],
}
KINDS = {"signup": "user_message", "view": "assistant_message", "purchase": "assistant_message", "click": "tool_use_stub", "error": "tool_result_stub"}
SAYS = {"signup": "user_message", "view": "view", "purchase": "purchase", "click": "tool_use_stub", "error": "tool_result_stub"}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _text() -> str:
    out = "case event_type"
    for event, key in SAYS.items():
        said = SAID[key]
        plain = key in ("tool_use_stub",)
        cases = " ".join(f"when {i} then {_quoted(s) if plain else f'concat({_quoted(s + ' ')}, n)'}" for i, s in enumerate(said))
        out += f" when '{event}' then case n % {len(said)} {cases} end"
    return out + " end"


SQL = f"""
select event_id, session_id, user_id, ts, value, n, line, kind, text,
       case when kind = 'tool_use_stub' then text end as input_text,
       case when kind = 'tool_result_stub' then case when n % 6 in (0, 2, 4) then 'failed' else 'ok' end end as status
from (
  select event_id, user_id, ts, value, cast(floor(value) as bigint) as n,
         concat('u', user_id, '-', cast(floor((day(ts) - 1) / 10) as int)) as session_id,
         cast(row_number() over (partition by user_id, floor((day(ts) - 1) / 10) order by ts, event_id) as bigint) as line,
         case event_type {" ".join(f"when '{e}' then '{k}'" for e, k in KINDS.items())} end as kind,
         {_text().replace("n %", "cast(floor(value) as bigint) %").replace(", n)", ", cast(floor(value) as bigint))")} as text
  from events
) as lines
"""
#: Turns of the overlay, as SQL over it.
TURNS_SQL = f"""
select *, concat(session_id, ':turn-', lpad(cast(turn_index as varchar), 4, '0')) as turn_id from (
  select *, greatest(g, 1) - 1 as turn_index from (
    select *, sum(case when kind = 'user_message' then 1 else 0 end) over (partition by session_id order by line rows unbounded preceding) as g,
           sum(case when kind = 'user_message' then 1 else 0 end) over (partition by session_id) as asked
    from ({SQL}) as o
  ) as counted where asked > 0
) as numbered
"""
