import pytest

from graphloom.plans import router as R

# Questions of an invented parcel depot.
CORPUS = [
    ("Who is listening for ParcelWeighed?", "find_listeners", "ParcelWeighed"), ("which subscribers to Depot\\Events\\VanLoaded", "find_listeners", "Depot\\Events\\VanLoaded"), ("who handles the VanLoaded event", "find_listeners", "VanLoaded"),
    ("flow of PUT /vans/{van}/load", "get_request_flow", "/vans/{van}/load"), ("print the flow for /depots.", "get_request_flow", "/depots"),
    ("which handles the weighbridge endpoint?", "find_handlers", "*weighbridge*"), ("handler of /vans/{van}", "find_handlers", "/vans/{van}"), ("what serves PATCH /vans/{van}", "find_handlers", "/vans/{van}"),
    ("follow delete /parcels/{parcel}", "trace_route", "/parcels/{parcel}"), ("HEAD /status", "trace_route", "/status"),
    ("what enqueues the WeighParcelJob", "find_jobs_dispatching", "WeighParcelJob"), ("is WeighParcelJob queued anywhere", "find_jobs_dispatching", "WeighParcelJob"),
    ("which class raises VanLoaded", "find_dispatchers", "VanLoaded"), ("where is ParcelWeighed emitted?", "find_dispatchers", "ParcelWeighed"), ("emitters of VanLoaded", "find_dispatchers", "VanLoaded"),
    ("which classes implement Depot\\Contracts\\Scale?", "find_implementations", "Depot\\Contracts\\Scale"), ("implementors of Scale", "find_implementations", "Scale"),
    ("who invokes Scale::tare?", "find_callers", "Scale::tare"), ("callers of `Depot\\Scale::read`", "find_callers", "`Depot\\Scale::read"), ("who calls the depot", "semantic_search", "who calls the depot"),
    ("permissions on the Parcel", "get_policy_for", "Parcel"), ("what guards Van?", "get_policy_for", "Van"), ("what provides ScaleClock", "resolve_binding", "ScaleClock"), ("is anything bound to Scale?", "resolve_binding", "Scale"),
    ("Depot\\Models\\Parcel", "get_model_context", "Depot\\Models\\Parcel"), ("open (see Depot\\Weighing\\Scale).", "describe_class", "Depot\\Weighing\\Scale"), ("open Depot\\Weighing\\Scale.", "describe_class", "Depot\\Weighing\\Scale"),
    ("which routes need a badge", "list_routes", ""), ("show every service-provider", "list_by_kind", "service_provider"), ("What policies do we have?", "list_by_kind", "policy"), ("list our form requests", "list_by_kind", "form_request"), ("which classes are there", "list_by_kind", "class"), ("list jobs of the depot", "semantic_search", "list jobs of the depot"),
    ("how does parcel weighing work?", "describe_flow", "parcel weighing"), ("take me through the loading of a van", "describe_flow", "loading of a van"), ("what happens once a van is full?", "describe_flow", "a van is full"),
    ("explore the Parcel aggregate", "explore_entity", "Parcel"), ("tell me about Scale.", "explore_entity", "Scale"), ("who is the Weigher?", "explore_entity", "Weigher"), ("what is it", "semantic_search", "what is it"),
    ("parcels lost last week", "semantic_search", "parcels lost last week"), ("", "semantic_search", ""), (None, "semantic_search", ""), ("describe\nParcel", "explore_entity", "Parcel"),
]


def test_corpus(spark):
    rows = spark.createDataFrame([(i, q, "clash", "_q") for i, (q, *_) in enumerate(CORPUS)], "i int, query string, tool_hint string, _words string")
    got = {r["i"]: r for r in R.route(rows).collect()}
    wrong = [(q, tool, arg, got[i]["tool"], got[i]["arg"]) for i, (q, tool, arg) in enumerate(CORPUS) if (got[i]["tool"], got[i]["arg"]) != (tool, arg)]
    assert not wrong
    methods = {q: got[i]["method"] for i, (q, *_) in enumerate(CORPUS) if got[i]["method"]}
    assert methods == {"flow of PUT /vans/{van}/load": "PUT", "follow delete /parcels/{parcel}": "DELETE", "HEAD /status": "HEAD"}
    assert got[8]["confidence"] == 0.95 and got[8]["fallbacks"] == "get_request_flow,semantic_search"


def test_every_intent_is_asked_for():
    assert {x.tool for x in R.GRAMMAR} | {"semantic_search"} == {tool for _, tool, _ in CORPUS}


def test_independent_sql_agrees(spark):
    """The SQL is written by hand and shares nothing with the grammar."""
    import duckdb

    from graphloom.plans.misc_queries import ORACLE

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'Ask-Log ')", [[i, q] for i, (q, *_) in enumerate(CORPUS)])
    want = sorted(con.execute(ORACLE["route_questions"]).fetchall())
    rows = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(CORPUS)], "doc_id int, query string")
    assert sorted(map(tuple, R.route(rows).drop("query").collect())) == want


def test_ask_falls_back_and_refuses(spark):
    some, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    scored = lambda v: spark.createDataFrame([(v,)], "vector_score double")
    tools = {"find_listeners": lambda a: some if a["event"] == "E" else none, "get_model_context": lambda a: none, "describe_class": lambda a: some, "semantic_search": lambda a: scored(0.7 if "good" in a["query"] else 0.3)}
    assert R.ask(spark, "who listens to E", tools).tool == "find_listeners"
    a = R.ask(spark, "App\\Models\\User", tools)
    assert (a.tool, a.alternatives_tried) == ("describe_class", ["get_model_context"])
    a = R.ask(spark, "who listens to good", tools)
    assert (a.tool, a.alternatives_tried) == ("semantic_search", ["find_listeners"])
    a = R.ask(spark, "who listens to X", tools)
    assert a.result is None and a.error_code == "no_confident_match" and a.alternatives_tried == ["find_listeners", "semantic_search"]


@pytest.mark.parametrize("i", [0])
def test_empty_table(spark, i):
    assert R.route(spark.createDataFrame([], "query string")).count() == 0
