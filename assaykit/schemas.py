"""Record types as Spark DDL."""

#: An item of the meta-evaluation. In dimensions a missing key is "not assessed", a null is "unverified".
ITEMS = """item_id bigint, version string, item_set string, split string, brief_id bigint, product_id string, source_id bigint,
mutation string, label_source string, labels map<string,boolean>, dimensions map<string,boolean>"""
OUTPUTS = """id string, `set` string, brief_id string, product_id string, image_sha string, country string, aspect_ratio string,
run struct<run_id:string,status:string,outcome:string,first_attempt_pass:boolean,repair_count:int,cost_usd:double,latency_ms:int>"""
LABELS = """image_sha string, `set` string, brief_id string, technical string, text string, product string, context string,
composition string, notes string, rubric_version string"""
EVENTS = "run_id bigint, seq int, type string, payload string, created_at timestamp"
