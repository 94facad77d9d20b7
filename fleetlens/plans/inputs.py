"""Fleet-shaped input views over the given tables.

Each view is one SQL text, a pure function of the parquet tables, read the same way by
Spark and by the checking engine. Only a few spellings differ; ``Dialect`` holds them.
All rows of a source table flow into its view.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def micros(self, e: str) -> str:
        return f"unix_micros(cast({e} as timestamp))" if self.name == "spark" else f"epoch_us({e})"

    def from_seconds(self, e: str) -> str:
        """Naive timestamp from whole seconds."""
        if self.name == "spark":
            return f"cast(timestamp_seconds({e}) as timestamp_ntz)"
        return f"make_timestamp(cast(({e}) as bigint) * 1000000)"

    def from_micros(self, e: str) -> str:
        if self.name == "spark":
            return f"cast(timestamp_micros({e}) as timestamp_ntz)"
        return f"make_timestamp({e})"

    def joined(self, e: str, order: str) -> str:
        if self.name == "spark":
            return f"string_agg({e}, ',') within group (order by {order})"
        return f"string_agg({e}, ',' order by {order})"

    def ntz(self, text: str) -> str:
        return f"timestamp_ntz '{text}'" if self.name == "spark" else f"timestamp '{text}'"

    def unhex(self, text: str) -> str:
        return f"unhex('{text}')"

    def utf8(self, e: str) -> str:
        return f"encode({e}, 'UTF-8')" if self.name == "spark" else f"encode({e})"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def view_sql(d: Dialect) -> dict[str, str]:
    """View name -> SELECT text. Views may refer to views listed before them."""
    us = d.micros
    rid = "concat('amr-', lpad(cast(user_id as string), 6, '0'))"
    sec = f"({us('ts')} / 1000000.0e0)"
    views: dict[str, str] = {}

    views["fx_events"] = f"""
        select event_id, ts, user_id, event_type, value, props, {rid} as robot_id,
               {us('ts')} as ts_us
        from events"""

    # ---- relayed topic samples -------------------------------------------------
    views["fx_samples"] = """
        select event_id, robot_id,
               case event_type when 'view' then 'chassis/bat_pct'
                               when 'click' then 'chassis/vel/linear'
                               when 'purchase' then 'chassis/motor/1/temp_c'
                               when 'signup' then 'nav/progress'
                               else 'diag/fault_code' end as topic,
               ts, ts_us,
               case when event_type = 'signup' then null else value end as num,
               props as payload,
               cast(case when event_id % 7 = 0 then 1 else 0 end as int) as flag
        from fx_events"""

    # ---- status messages, one typed row per message ----------------------------
    views["fx_status"] = """
        select event_id, robot_id, ts, ts_us,
               case when event_id % 11 = 0 then null else value end as battery,
               case event_type when 'view' then 'idle' when 'purchase' then 'charging'
                               when 'error' then 'error' else 'moving' end as state,
               case when event_type = 'click' then (event_id % 100) / 100.0e0 else 0.0e0 end as v,
               case when event_id % 5 = 0 then null else (event_id % 40) / 100.0e0 - 0.2e0 end as w,
               case when event_id % 13 = 0 then null else 30 + (event_id % 50) / 2.0e0 end as temp,
               cast(-(40 + user_id % 50) as double) as wifi,
               event_id * 1.5e0 as odom,
               case when event_type = 'error' then concat('E', cast(event_id % 3 as string)) else '' end as errors
        from fx_events"""

    # ---- raw (topic, payload) messages -----------------------------------------
    num = "cast(value as string)"
    envelope = (
        f"concat('{{\"v\":1,\"id\":\"', robot_id, '\",\"boot\":\"b', cast(event_id % 4 as string),"
        f" '\",\"seq\":', cast(event_id as string), ',\"ts\":', cast({sec} as decimal(18,3)),"
        f" ',\"b\":[[\"nav/a\",', cast({sec} - 5 as decimal(18,3)), ',', {num}, ',0],"
        f"[\"nav/b\",', cast({sec} - 4 as decimal(18,3)), ',\"on\",1],[\"\",1,2,0],[\"nav/short\"],7,"
        f"[\"nav/c\",0,', props, ']]}}')"
    )
    views["fx_messages"] = f"""
        select event_id,
               case when event_type = 'view' then concat('fleet/', robot_id, '/status')
                    when event_type = 'click' then concat('fleet/', robot_id,
                         case when event_id % 2 = 0 then '/samples' else '/raw' end)
                    when event_type = 'purchase' then concat('fleet/', robot_id, '/status')
                    when event_type = 'signup' then concat('fleet/', robot_id, '/lwt')
                    when event_id % 3 = 0 then concat('fleet/', robot_id)
                    when event_id % 3 = 1 then concat('fleet/', robot_id, '/cmd')
                    else concat('fleet/', robot_id, '/status') end as topic,
               case when event_type = 'view' then
                      concat('{{"name":"AMR ', cast(user_id as string), '","state":"idle","battery":', {num},
                             ',"pose":{{"x":', {num}, ',"y":-1.5,"yaw":0.25}},"vel":{{"v":0.5,"w":0.125}},',
                             '"mission":{{"id":"m', cast(event_id % 9 as string), '","progress":0.5}},',
                             '"errors":["E1","E', cast(event_id % 3 as string), '"],"temp":41.5,"wifi":-60,',
                             '"odom":', {num}, ',"gripper":"open"}}')
                    when event_type = 'purchase' then
                      concat('{{"id":"alias-', cast(user_id as string), '","status":"charging","batt":"', {num},
                             '","x":1.5,"y":"bad","theta":0.75,"linear":0.25,"angular":-0.5,"mission":"dock",',
                             '"error":"', case when event_id % 2 = 0 then 'E9' else '' end,
                             '","temperature":null,"rssi":-70,"odom_m":', {num}, '}}')
                    when event_type = 'signup' then
                      case event_id % 6 when 0 then ' online ' when 1 then '"OFFLINE"' when 2 then '1'
                                        when 3 then 'true' when 4 then 'up' else 'down' end
                    when event_type = 'click' then
                      case event_id % 5 when 0 then '{{"nope":1}}' when 1 then concat('{{"b":[["nav/old",1,', {num}, ']]}}')
                                        when 2 then concat('[["nav/list",null,', {num}, ',"x"]]')
                                        else {envelope} end
                    when event_id % 2 = 0 then '[1,2,3]'
                    else '{{"battery": 12' end as payload,
               ts + interval 2 second as recv_ts
        from fx_events""".replace("{{", "{").replace("}}", "}")

    # ---- status messages with poses and missions, in every spelling that they come in ---
    pose = "concat('{{\"pose\":{{\"x\":', cast(event_id % 97 as string), '.25,\"y\":-', cast(event_id % 31 as string), '.5,\"yaw\":0.75}}"
    views["fx_poses"] = f"""
        select event_id, ts as recv_ts, concat('fleet/', robot_id, '/status') as topic,
               case event_id % 7
                    when 0 then {pose},"mission":{{"id":"m', cast(event_id % 9 as string), '","progress":0.', cast(event_id % 10 as string), '}}}}}}}}')
                    when 1 then concat('{{"x":', cast(user_id as string), '.125,"mission":{{"name":"tour ', cast(event_id % 5 as string), '"}}}}}}}}')
                    when 2 then '{{"mission":"dock","y":7.5}}'
                    when 3 then {pose}}}')
                    when 4 then concat('{{"mission":{{}},"v":', cast(event_id % 3 as string), '.0004}}')
                    when 5 then concat('{{"battery":', cast(event_id % 120 as string), ',"mission":null}}')
                    else '{{"state":"idle"}}' end as payload
        from fx_events""".replace("{{", "{").replace("}}", "}")

    # ---- relayed batches: one envelope per robot and six hours ------------------
    views["fx_batch_rows"] = f"""
        select robot_id, user_id, cast(floor({us('ts')} / 21600000000.0e0) as bigint) as slot, event_id, ts,
               case when user_id % 10 = 3 then 300 when user_id % 10 = 7 then -45 else 0 end as skew_s,
               value, event_type
        from fx_events"""
    rowtext = (
        "concat('[\"', case event_type when 'view' then 'chassis/bat_pct' when 'click' then 'chassis/vel/linear'"
        " when 'purchase' then 'chassis/motor/1/temp_c' when 'signup' then 'nav/progress'"
        " else 'diag/fault_code' end, '\",',"
        f" cast({us('ts')} / 1000000.0e0 + skew_s as decimal(18,3)), ',',"
        " case when event_type = 'error' then concat('\"', cast(value as string), '\"')"
        " when event_type = 'signup' then case when event_id % 2 = 0 then 'true' else 'false' end"
        " else cast(value as string) end,"
        " ',', case when event_id % 7 = 0 then '1' else '0' end, ']')"
    )
    views["fx_batch_text"] = f"""
        select robot_id, user_id, slot, skew_s, count(*) as n, max(ts) as last_ts,
               {d.joined(rowtext, 'event_id')} as body
        from fx_batch_rows group by robot_id, user_id, slot, skew_s"""
    views["fx_batches"] = f"""
        select concat('fleet/', robot_id, '/', copy) as topic, robot_id, slot, n,
               case when user_id % 25 = 24 then null else concat('b', cast(slot % 5 as string)) end as boot,
               case when user_id % 25 = 24 then null else slot end as seq,
               last_ts + interval 2 second + lag_s * interval 1 second as recv_ts,
               concat('{{', case when user_id % 25 = 24 then ''
                    else concat('"v":1,"id":"', robot_id, '","boot":"b', cast(slot % 5 as string),
                                '","seq":', cast(slot as string), ',"ts":',
                                cast({us('last_ts')} / 1000000.0e0 + skew_s + 1.5e0 as decimal(18,3)), ',') end,
                      '"b":[', body, ']}}') as payload
        from (select *, 'samples' as copy, 0 as lag_s from fx_batch_text
              union all
              select *, 'raw' as copy, 5 as lag_s from fx_batch_text
              where (user_id + slot) % 6 = 0 and user_id % 25 <> 24) t""".replace("{{", "{").replace("}}", "}")

    # ---- last-will messages ------------------------------------------------------
    views["fx_lwt"] = """
        select event_id, robot_id, ts + interval 1 hour as ts, ts_us + 3600000000 as ts_us,
               case when event_id % 2 = 0 then 'offline' else 'online' end as payload
        from fx_events where event_type = 'signup'"""

    # ---- registry ------------------------------------------------------------------
    sha = "sha2({}, 256)" if d.name == "spark" else "sha256({})"
    secret = "concat('s-', cast(user_id as string))"
    views["fx_robots"] = f"""
        select {rid} as id, concat('AMR-', cast(user_id as string)) as name,
               case when user_id % 17 = 0 then {d.ntz('2024-01-20 00:00:00')} end as revoked_at,
               case when user_id % 17 <> 0 and user_id % 19 <> 0 then {sha.format(secret)} end as secret_hash,
               first_ts as enrolled_at
        from (select user_id, min(ts) as first_ts from events group by user_id) t
        union all
        select concat('ghost-', cast(s_suppkey as string)), s_name, null, null, {d.ntz('2024-01-01 00:00:00')}
        from supplier"""
    views["fx_tokens"] = f"""
        select concat('TOK-', cast(c_custkey as string)) as token,
               concat('amr-', lpad(cast(c_custkey % 150 as string), 6, '0')) as robot_id,
               {d.ntz('2024-01-01 00:00:00')} + (c_custkey % 720) * interval 1 hour as created_at,
               {d.ntz('2024-01-02 00:00:00')} + (c_custkey % 720) * interval 1 hour as expires_at,
               case when c_custkey % 3 = 0
                    then {d.ntz('2024-01-01 06:00:00')} + (c_custkey % 720) * interval 1 hour end as used_at
        from customer"""
    views["fx_token_claims"] = """
        select o_orderkey as claim_id,
               case when o_orderkey % 10 = 9 then concat('tok-x', cast(o_custkey as string))
                    else concat(' tok-', cast(o_custkey as string), ' ') end as token,
               o_custkey
        from orders"""
    views["fx_connects"] = f"""
        select event_id, ts,
               case when event_id % 13 = 0 then concat('ghost-', cast(user_id as string)) else {rid} end as username,
               case when event_id % 9 = 0 then 'guess' else concat('s-', cast(user_id as string)) end as secret
        from events"""
    views["fx_publishes"] = """
        select event_id, ts, case when event_id % 29 = 0 then '' else robot_id end as username,
               case event_id % 8 when 0 then concat('fleet/', robot_id, '/status')
                                 when 1 then concat('fleet/', robot_id, '/samples')
                                 when 2 then concat('fleet/', robot_id, '/raw')
                                 when 3 then concat('fleet/', robot_id, '/lwt')
                                 when 4 then concat('fleet/', robot_id, '/cmd')
                                 when 5 then 'fleet/amr-000001/status'
                                 when 6 then 'fleet/+/status' else '#' end as topic,
               case when event_id % 16 >= 12 then 'subscribe' else 'publish' end as action
        from fx_events"""

    # ---- alert log and audit log -----------------------------------------------------
    views["fx_alerts"] = """
        select o_orderkey as id, cast(o_orderkey % 8 as int) as rule_id,
               concat('rule-', cast(o_orderkey % 8 as string)) as rule_name,
               concat('amr-', lpad(cast(o_custkey % 150 as string), 6, '0')) as robot_id,
               case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'critical'
                                    when '5-LOW' then 'info' else 'warn' end as severity,
               concat('order ', cast(o_orderkey as string), ' total ', o_orderpriority) as message,
               o_totalprice as value,
               o_orderdate + (o_orderkey % 86400) * interval 1 second as started_at,
               case when o_orderstatus = 'O' then null
                    else o_orderdate + (o_orderkey % 86400 + 60 + o_custkey % 7200) * interval 1 second end as resolved_at
        from orders"""
    views["fx_audit"] = """
        select event_id as id, robot_id, ts,
               case event_type when 'view' then 'online' when 'click' then 'state' when 'purchase' then 'enroll'
                               when 'signup' then 'revoke' else 'error' end as kind,
               case event_type when 'error' then 'critical' when 'signup' then 'warn' else 'info' end as severity,
               props as detail
        from fx_events"""

    # ---- alert rules: a dimension like any other, one rule per row of a given table ---
    texts = "array<string>" if d.name == "spark" else "varchar[]"
    n, nth = "n_nationkey", "cast(floor(n_nationkey / 6.0e0) as int)"
    views["fx_rules"] = f"""
        select cast({n} + 101 as int) as rule_id, lower(n_name) as rule_name, {n} % 12 <> 11 as enabled,
               case when {n} % 10 = 4 then 'amr-000007' end as scope,
               case {n} % 6 when 1 then 'presence' when 3 then 'presence' when 5 then 'topic' else 'field' end as source,
               case {n} % 6 when 0 then 'age' when 2 then 'battery' when 4 then 'gripper' when 5 then 'chassis/bat_pct' else '' end as key,
               case {n} % 6 when 0 then case {nth} % 5 when 0 then 'gt' when 1 then 'outside' when 2 then 'lt' when 3 then 'inside' else 'gt' end
                            when 1 then case {nth} when 0 then 'gt' when 1 then 'eq' when 2 then 'ne' else 'lt' end
                            when 3 then 'offline' when 4 then case {nth} % 2 when 0 then 'eq' else 'ne' end
                            when 2 then 'lt' else 'inside' end as op,
               cast(case {n} % 6 when 0 then 3600 * (10 + {n}) when 1 then 0.5 when 2 then 20 + {n}
                                 when 3 then case {nth} when 0 then null when 1 then 7200 when 2 then 0 else 864000 end when 5 then 10 end as double) as value,
               cast(case {n} % 6 when 0 then 3600 * (30 + {n}) when 5 then 15 + {n} end as double) as value2,
               case {n} % 6 when 1 then case {nth} when 1 then 'stale' else 'ok' end when 4 then 'open' end as text_value,
               cast(3600 * 6 * ({n} % 3) as double) as for_seconds,
               cast(case when {n} = 24 then 3600 * 12 when {n} % 6 = 2 then 30 + {n} end as double) as clear_value,
               case {n} % 3 when 0 then 'critical' when 1 then 'warn' else 'info' end as severity,
               cast(1440 * ({n} % 4) as double) as cooldown_min, cast(null as {texts}) as channels, cast(null as string) as message_template
        from nation"""

    rest = "rule_id, rule_name, scope, source, key, op, value2, text_value, for_seconds, clear_value, severity, cooldown_min"
    views["fx_rule_versions"] = f"""
        select {rest}, enabled, value, {d.ntz('2024-01-01 00:00:00')} + (rule_id % 3) * interval 1 day as valid_from from fx_rules
        union all
        select {rest}, rule_id % 4 <> 0, value + 5, {d.ntz('2024-01-16 00:00:00')} from fx_rules where rule_id % 2 = 0"""

    # ---- push subscriptions and delivery results ----------------------------------------
    views["fx_push"] = f"""
        select concat('https://push.example.net/send/', lpad(cast(c_custkey as string), 40, 'k')) as endpoint,
               concat('p', cast(c_custkey as string)) as p256dh, concat('a', cast(c_custkey as string)) as auth,
               case when c_custkey % 4 = 0 then null else c_mktsegment end as label,
               c_name as user_agent,
               {d.ntz('2024-01-01 00:00:00')} + c_custkey * interval 1 minute as created_at,
               cast(null as {"timestamp_ntz" if d.name == "spark" else "timestamp"}) as last_ok,
               cast(c_custkey % 3 as int) as failures
        from customer"""
    views["fx_resubscribes"] = f"""
        select concat('https://push.example.net/send/', lpad(cast(o_custkey * 2 as string), 40, 'k')) as endpoint,
               concat('q', cast(o_orderkey as string)) as p256dh, concat('b', cast(o_orderkey as string)) as auth,
               case when o_orderkey % 3 = 0 then null else o_orderpriority end as label,
               o_orderkey as arrival
        from orders"""
    views["fx_deliveries"] = """
        select concat('https://push.example.net/send/', lpad(cast(o_custkey as string), 40, 'k')) as endpoint,
               o_orderkey as attempt,
               cast(case o_orderkey % 40 when 0 then 404 when 1 then 410 when 2 then 500 else 200 end as int) as status_code
        from orders"""

    # ---- traffic, logins, volumes, recordings ---------------------------------------------
    views["fx_requests"] = """
        select event_id, ts, ts_us, case when event_id % 3 = 0 then 'ws' else 'http' end as kind,
               40 * length(props) + event_id % 500 as body_bytes
        from fx_events"""
    views["fx_logins"] = """
        select event_id, ts, ts_us, concat('10.0.0.', cast(user_id % 20 as string)) as client,
               event_type = 'signup' as ok
        from fx_events"""
    views["fx_disk"] = """
        select event_id, ts, ts_us, concat('vol-', cast(user_id % 10 as string)) as volume, value as free_pct
        from fx_events"""
    views["fx_transfers"] = """
        select event_id, ts, ts_us, robot_id as session, cast(1000 * (1 + event_id % 4) as bigint) as size_bytes,
               cast(round(value * 1000, 0) as bigint) as bytes, 0.5e0 + (event_id % 8) / 4.0e0 as seconds
        from fx_events"""
    views["fx_files"] = """
        select concat('rec-', lpad(cast(doc_id as string), 10, '0'), '.jsonl.gz') as name, doc_id as seq,
               n_chars as size
        from documents"""

    # ---- loosely typed values -------------------------------------------------------------
    views["fx_values"] = """
        select event_id,
               case event_id % 20 when 0 then 'TRUE' when 1 then ' on ' when 2 then 'no' when 3 then 'F'
                    when 4 then '' when 5 then '   ' when 6 then 'nan' when 7 then '-Infinity' when 8 then '1e400'
                    when 9 then concat(cast(value as string), 'd') when 10 then concat('1_', cast(event_id as string))
                    when 11 then concat(' ', cast(value as string), ' ') when 12 then '.5'
                    when 13 then concat('text ', cast(event_id as string))
                    when 14 then concat('000000000000000000000000000000000', cast(event_id as string))
                    when 15 then cast(event_id as string) when 16 then '+7' when 17 then '1e3'
                    when 18 then concat('-', cast(value as string)) else cast(value as string) end as raw
        from events"""
    views["fx_time_args"] = f"""
        select event_id,
               case event_id % 6 when 0 then cast(cast(floor({us('ts')} / 1000000.0e0) as bigint) as string)
                    when 1 then concat(cast(cast(floor({us('ts')} / 1000000.0e0) as bigint) as string), '.5')
                    when 2 then '2024-01-05T06:07:08Z'
                    when 3 then concat('2024-01-', lpad(cast(1 + user_id % 28 as string), 2, '0'), 'T10:00:00+02:00')
                    when 4 then concat('2024-02-', lpad(cast(1 + user_id % 28 as string), 2, '0'), ' 11:12:13')
                    else concat('soon ', cast(user_id as string)) end as raw
        from events"""
    views["fx_payloads"] = f"""
        select event_id, concat('raw/', event_type) as topic, ts,
               case event_id % 6 when 0 then {d.utf8("concat(' ', props, ' ')")}
                    when 1 then {d.utf8("cast(value as string)")}
                    when 2 then {d.utf8("concat('plain ', event_type)")}
                    when 3 then {d.unhex('C3280102FF')}
                    when 4 then {d.utf8("'  '")}
                    else {d.utf8("concat('[1, ', cast(event_id as string))")} end as payload
        from events"""
    views["fx_nested"] = """
        select event_id,
               concat('{"hdr":{"seq":', cast(event_id as string), ',"frame":"base"},"ok":',
                      case when event_id % 2 = 0 then 'true' else 'false' end,
                      ',"gap":null,"empty":{},"vals":[', cast(value as string), ',1,2],',
                      '"nine":[1,2,3,4,5,6,7,8,9],"eight":[1,2,3,4,5,6,7,', cast(user_id as string), '],',
                      '"a":{"b":{"c":{"d":{"e":{"f":', cast(user_id as string), ',"g":{"h":1}}}}}},',
                      '"objs":[{"k":', cast(event_id as string), '},{"k":"x"}]}') as body
        from events"""
    return views
