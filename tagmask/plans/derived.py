"""Dossier tables derived from the given tables. The SQL is plain enough to mean the same in Spark and in DuckDB.

A dossier is a customer, its letters are the customer's orders; persons come from part names in four writing styles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.sources.scratch import kept_by

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PERSON = """case p_partkey % 4
  when 0 then concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))
  when 1 then concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
  when 2 then concat(upper(substr(p_name, 1, 1)), '. ', split_part(p_name, ' ', 2))
  else concat('Sig. ', p_name) end"""

#: name -> (tables and earlier names it needs are found by name, SQL)
SQL = {
    "persons": f"select p_partkey, p_brand as dossier_id, {_PERSON} as person from part",
    "letter_parts": """select concat('D', cast(o_custkey as string)) as dossier_id, o_orderkey as arrival, concat('d_', cast(o_orderkey as string)) as doc_id,
      concat('lettera_', cast(o_orderkey % 7 as string), '.txt') as filename, c_name, person, cast(floor(o_totalprice) as bigint) as amount,
      substr(cast(cast(o_orderdate as date) as string), 1, 10) as day, o_orderkey as number, o_custkey as custkey
      from orders join customer on c_custkey = o_custkey join persons on p_partkey = o_orderkey % (select max(p_partkey) from part) + 1""",
    "letters": """select dossier_id, doc_id, arrival, filename, concat('Il cliente ', c_name, ' e ', person, ' pagano EUR ', cast(amount as string), ' il ', day,
      '. Pratica n. P/', cast(number as string), ', scrivere a u', cast(custkey as string), '@example.com. Firmato: ', person, '.') as text from letter_parts""",
    "detections": """select dossier_id, doc_id, arrival, 0 as det_seq, c_name as value, 'AZIENDA' as category from letter_parts
      union all select dossier_id, doc_id, arrival, 1, person, 'PERSONA' from letter_parts
      union all select dossier_id, doc_id, arrival, 2, concat('EUR ', cast(amount as string)), 'IMPORTO' from letter_parts
      union all select dossier_id, doc_id, arrival, 3, day, 'DATA' from letter_parts
      union all select dossier_id, doc_id, arrival, 4, concat('P/', cast(number as string)), 'PRATICA' from letter_parts
      union all select dossier_id, doc_id, arrival, 5, concat('u', cast(custkey as string), '@example.com'), 'EMAIL' from letter_parts
      union all select dossier_id, doc_id, arrival, 6, split_part(person, ' ', 2), 'PERSONA' from letter_parts where arrival % 3 = 0
      union all select dossier_id, doc_id, arrival, 7, upper(person), 'PERSONA' from letter_parts where arrival % 11 = 0
      union all select dossier_id, doc_id, arrival, 8, '', 'PERSONA' from letter_parts where arrival % 5 = 0""",
    "switches": "select distinct dossier_id, 'DATA' as category, custkey % 2 = 0 as enabled from letter_parts where custkey % 3 = 0",
    "page_stats": """select concat('S', cast(l_suppkey as string)) as dossier_id, concat('d_', cast(l_orderkey as string)) as doc_id,
      cast(row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey, l_quantity) as int) as page_no,
      repeat('x', cast(l_quantity as int)) as text, cast(l_discount * 10 as double) as image_area, cast(1 as double) as page_area from lineitem""",
    "state_events": """select cast(user_id as string) as dossier_id, event_id as seq, case event_type when 'signup' then 'analysed' when 'purchase' then 'approve'
      when 'click' then 'mutation' when 'error' then 'clear' else 'other' end as event, concat('h', cast(event_id as string)) as digest from events""",
    "usage": "select cast(user_id as string) as session_id, event_id % 1000 as token_in, event_id % 37 as token_out from events",
    "responses": """select dossier_id, cast(p_partkey as string) as doc_id, p_partkey as arrival,
      case when p_partkey % 17 = 0 then '[{"valore": "' when p_partkey % 19 = 0 then '{"valore": "x"}' when p_partkey % 23 = 0 then '[]'
      when p_partkey % 29 = 0 then concat('[{"valore": ', cast(p_partkey as string), ', "categoria": "PERSONA"}]')
      when p_partkey % 31 = 0 then concat('[{"valore": "', person, '", "categoria": "PERSONE"}]') when p_partkey % 37 = 0 then '["ciao"]'
      else concat('[{"valore": "', person, '", "categoria": "PERSONA", "nota": 1}, {"categoria": "DATA", "valore": "2024-01-0', cast(p_partkey % 9 + 1 as string), '"}]') end as raw from persons""",
    "codes": """select c_custkey as k, concat(case when c_custkey % 2 = 0 then 'IT' else '' end, lpad(cast(c_custkey * 7919 % 99999999999 as string), 11, '0')) as vat,
      concat('IT', lpad(cast(c_custkey * 37 % 100 as string), 2, '0'), 'X', lpad(cast(c_custkey as string), 22, '0')) as iban,
      concat('RSSMRA', lpad(cast(c_custkey % 100 as string), 2, '0'), 'M', lpad(cast(c_custkey % 31 + 1 as string), 2, '0'), 'H', lpad(cast(c_custkey % 1000 as string), 3, '0'), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(c_custkey % 26 + 1 as int), 1)) as cf,
      concat(cast(c_custkey % 33 as string), '/', cast(c_custkey % 14 as string), '/', cast(1990 + c_custkey % 40 as string)) as day,
      concat(case when c_custkey % 3 = 0 then '+39' when c_custkey % 3 = 1 then '0039' else '' end, ' ', cast(c_custkey * 104729 % 100000000000 as string)) as phone from customer""",
}


def _detections(parts: DataFrame) -> DataFrame:
    """The rows of SQL["detections"] in one pass: as a union each branch would join orders, customers and persons again."""
    text, row = lambda c: F.col(c).cast("string"), lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("det_seq", "value", "category"), strict=True)])
    found = lambda seq, value, category, when=None: row(F.lit(seq), value, F.lit(category)) if when is None else F.when(F.expr(when), row(F.lit(seq), value, F.lit(category)))
    person = F.col("person")
    rows = F.array(
        found(0, F.col("c_name"), "AZIENDA"), found(1, person, "PERSONA"), found(2, F.concat(F.lit("EUR "), text("amount")), "IMPORTO"), found(3, F.col("day"), "DATA"),
        found(4, F.concat(F.lit("P/"), text("number")), "PRATICA"), found(5, F.concat(F.lit("u"), text("custkey"), F.lit("@example.com")), "EMAIL"),
        found(6, F.split_part("person", F.lit(" "), F.lit(2)), "PERSONA", "arrival % 3 = 0"), found(7, F.upper("person"), "PERSONA", "arrival % 11 = 0"), found(8, F.lit(""), "PERSONA", "arrival % 5 = 0"),
    )
    return parts.select("dossier_id", "doc_id", "arrival", F.inline(F.array_compact(rows)))


def register(spark: SparkSession, sf_dir: str, *names: str, keep: bool = False) -> dict[str, DataFrame]:
    """The named derived tables, with temporary views for whatever they need.

    With `keep` the parts of letters are written once, by dossier, so that what is made of them is not joined again, and what
    is worked out per dossier needs no further shuffle, nor do joins by dossier and more.
    """
    if keep:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for table in TABLES:
        if any(table in sql for sql in SQL.values()):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    out = {}
    for name, sql in SQL.items():
        out[name] = _detections(out["letter_parts"]) if name == "detections" else spark.sql(sql)
        if keep and name == "letter_parts":
            out[name] = kept_by(out[name], "dossier_id")
        out[name].createOrReplaceTempView(name)
    return {n: out[n] for n in names}


def with_derived(sql: str) -> str:
    """A DuckDB query over the derived tables."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in SQL.items()) + ",\n" + sql.strip()
