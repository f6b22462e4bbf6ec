"""Query of the line dedup."""

from __future__ import annotations

from contactlake.llm import line_runs
from contactlake.llm.registry import documents, query

_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10),
marked as (select doc_id, pos, line, k in (select k from common) as gone from keyed)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query("op9_line_runs", _SQL)
def op9_line_runs(spark, sf_dir):
    kept = line_runs.drop_common_lines(documents(spark, sf_dir))
    return kept.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256) as kept_sha256")
