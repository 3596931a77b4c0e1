"""Registered queries of the source index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import CONFIG_NAMES, CONFIG_SUFFIXES, EXPORT_LIST, EXPORTED, EXTENSIONS, IMPORTS, SKIPPED_FOLDERS, SYMBOLS
from ..operators import index
from ..sources.scratch import written
from .ingest_queries import TOKENS, quoted
from .retrieval_queries import _PLAIN, _tasks
from .seeds import ctes, seed


def _files(spark, d, name="files"):
    return index.admitted(seed(spark, d, name))


def _index(spark, d, name="files"):
    return index.indexed(_files(spark, d, name))


def file_admission(spark, d):
    return _files(spark, d).select("project_id", "path")


def file_facts(spark, d):
    return _index(spark, d).select("project_id", "path", "extension", "size", "sha256", "token_count", "is_config", "line_count")


def symbol_extraction(spark, d):
    return _index(spark, d).select("project_id", "path", F.explode("symbols").alias("s")).select("project_id", "path", "s.*")


def symbol_lines(spark, d):
    return index.symbol_lines(_files(spark, d))


def import_extraction(spark, d):
    return index.dependencies(_index(spark, d))


def export_names(spark, d):
    return _index(spark, d).filter(F.size("exports") > 0).select("project_id", "path", F.array_join("exports", ",").alias("exports"))


def index_stats(spark, d):
    return index.index_stats(_index(spark, d))


def _hashes(spark, d, name):
    return _files(spark, d, name).select("project_id", "path", F.sha2("content", 256).alias("sha256"))


def index_diff(spark, d):
    return index.diff(_hashes(spark, d, "files_before"), _hashes(spark, d, "files"))


def index_refresh(spark, d):
    after = index.refresh(written(_index(spark, d, "files_before"), "index"), _files(spark, d))
    return after.select("project_id", "path", "sha256", "token_count", F.size("symbols").alias("n_symbols"))


def file_cards(spark, d):
    return index.file_cards(_index(spark, d))


def relevant_files(spark, d):
    return index.relevant_files(_tasks(spark, d), _index(spark, d)).select("task_id", "rank", "path", "score")


QUERIES = {f.__name__: f for f in (file_admission, file_facts, symbol_extraction, symbol_lines, import_extraction, export_names, index_stats, index_diff, index_refresh, file_cards, relevant_files)}


def _in(words):
    return "(" + ", ".join(map(quoted, words)) + ")"


_EXT = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
_NAME = "string_split(path, '/')[-1]"


def _admitted(name):
    return f"""select * from (select *, row_number() over (partition by project_id order by path) as n_ from {name} where len(list_filter(string_split(path, '/')[1:-2], lambda f: f in {_in(SKIPPED_FOLDERS)} or starts_with(f, '.'))) = 0
  and ({_EXT} in {_in(EXTENSIONS)} or {_NAME} in {_in(CONFIG_NAMES)}) and not starts_with({_NAME}, '.') and strlen(content) <= 1000000) where n_ <= 5000"""


def _all(patterns):
    return "list_concat(" + ", ".join(f"regexp_extract_all(content, {quoted('(?m)' + p)}, 1)" for p in patterns) + ", []::varchar[])" if len(patterns) > 1 else f"regexp_extract_all(content, {quoted('(?m)' + patterns[0])}, 1)"


def _concat(parts):
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_SYMBOLS = _concat([f"list_transform(regexp_extract_all(content, {quoted('(?m)' + p)}, 1), lambda n: {{'name': n, 'kind': '{k}'}})" for k, p in SYMBOLS])
_IMPORTS = _concat([f"regexp_extract_all(content, {quoted('(?m)' + p)}, 1)" for p in IMPORTS])
_EXPORTS = _concat([f"regexp_extract_all(content, {quoted('(?m)' + EXPORTED)}, 1)", f"list_transform(flatten(list_transform(regexp_extract_all(content, {quoted('(?m)' + EXPORT_LIST)}, 1), lambda x: string_split(x, ','))), lambda x: trim(string_split(trim(x), ' as ')[-1]))"])
_CONFIG = f"({_NAME} in {_in(CONFIG_NAMES)} or {_EXT} in {_in(CONFIG_SUFFIXES)})"


def _indexed(name, out="idx"):
    return f"""{out} as (select project_id, path, {_EXT} as extension, strlen(content)::int as size, sha256(content) as sha256, {TOKENS.format('content')}::int as token_count, {_CONFIG} as is_config, (len(content) - len(replace(content, chr(10), '')) + 1)::int as line_count,
  list_sort(list_distinct(list_filter(list_transform({_IMPORTS}, lambda x: trim(x)), lambda x: x <> ''))) as imports, {_EXPORTS} as export_names, case when {_CONFIG} then [] else list_filter({_SYMBOLS}, lambda s, i: list_position({_SYMBOLS}, s) = i) end as symbols from ({_admitted(name)}))"""


_I = ctes("files") + ", " + _indexed("files")
_DIFF = ctes("files", "files_before") + f""", a as (select project_id, path, sha256(content) as sha from ({_admitted('files_before')})), b as (select project_id, path, sha256(content) as sha from ({_admitted('files')})),
  both_ as (select coalesce(a.project_id, b.project_id) as project_id, a.path as old_path, b.path as new_path, a.sha as old_sha, b.sha as new_sha from a full outer join b on a.project_id = b.project_id and a.path = b.path),
  gone as (select *, row_number() over (partition by project_id, old_sha order by old_path) as k from both_ where new_path is null), new_ as (select *, row_number() over (partition by project_id, new_sha order by new_path) as k from both_ where old_path is null),
  changes as (select project_id, 'modified' as change, old_path, new_path from both_ where old_sha <> new_sha
    union all select coalesce(g.project_id, n.project_id), case when n.new_path is null then 'deleted' when g.old_path is null then 'added' else 'renamed' end, g.old_path, n.new_path from gone g full outer join new_ n on g.project_id = n.project_id and g.old_sha = n.new_sha and g.k = n.k)"""
SQL = {
    "file_admission": ctes("files") + f" select project_id, path from ({_admitted('files')})",
    "file_facts": _I + " select project_id, path, extension, size, sha256, token_count, is_config, line_count from idx",
    "symbol_extraction": _I + " select project_id, path, s.name as name, s.kind as kind, list_contains(export_names, s.name) as exported from (select *, unnest(symbols) as s from idx)",
    "symbol_lines": ctes("files") + ", kept_ as (" + _admitted("files") + f"), lines_ as (select project_id, path, unnest(string_split(content, chr(10))) as said, generate_subscripts(string_split(content, chr(10)), 1)::int as line from kept_ where not {_CONFIG}), found_ as (" + " union all ".join(
        f"select project_id, path, regexp_extract(said, {quoted(p)}, 1) as name, '{k}' as kind, {order} as o, line from lines_" for order, (k, p) in enumerate(SYMBOLS)) + ") select project_id, path, name, kind, line from (select *, row_number() over (partition by project_id, path, name, kind order by o, line) as n from found_ where name <> '') where n = 1",
    "import_extraction": _I + " select project_id, path, unnest(imports) as module from idx",
    "export_names": _I + ", e as (select project_id, path, list_sort(list_distinct(list_filter(list_transform(symbols, lambda s: s.name), lambda n: list_contains(export_names, n)))) as x from idx) select project_id, path, array_to_string(x, ',') as exports from e where len(x) > 0",
    "index_stats": _I + " select project_id, extension, count(*) as files, sum(token_count)::bigint as tokens, sum(len(symbols))::bigint as symbols, sum(is_config::int)::bigint as config_files from idx group by grouping sets ((project_id, extension), (project_id))",
    "index_diff": _DIFF + " select * from changes",
    "index_refresh": _I + " select project_id, path, sha256, token_count, len(symbols)::int as n_symbols from idx",
    "file_cards": _I + " select project_id, path, 'File ' || path || case when len(symbols) > 0 then ' defines ' || array_to_string(list_transform(symbols[1:8], lambda s: s.name), ', ') else '' end || case when len(imports) > 0 then '; imports ' || array_to_string(imports[1:6], ', ') else '' end as content from idx",
    "relevant_files": _I.replace("with files", ctes("tasks") + ", files", 1) + f""", k as (select task_id, {_PLAIN.format('task')} as w from tasks), e as (select task_id, unnest(w) as word, generate_subscripts(w, 1) as pos from k), c as (select task_id, word, count(*) as n, min(pos) as f from e group by 1, 2),
  kw as (select task_id, word from (select *, row_number() over (partition by task_id order by n desc, f) as r from c) where r <= 10),
  t as (select project_id, path, lower(path || ' ' || array_to_string(list_transform(symbols, lambda s: s.name), ' ') || ' ' || array_to_string(imports, ' ')) as text from idx),
  s as (select task_id, path, round(sum(2.0 * (length(text) - length(replace(text, word, ''))) / length(word) + case when contains(lower(path), word) then 2.0 else 0.0 end), 3)::double as score from t join tasks using (project_id) join kw using (task_id) group by 1, 2)
  select * from (select task_id, row_number() over (partition by task_id order by score desc, path)::int as rank, path, score from s where score > 0) where rank <= 5""",
}
