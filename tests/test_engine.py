"""End to end on small sources, against hand-traced results."""

from __future__ import annotations

import pytest

from ripplegraph.engine import Engine, UnresolvedError
from ripplegraph.functions.changes import ChangeError
from ripplegraph.operators import report
from ripplegraph.schema import EXACT
from ripplegraph.sources.store import NotIndexedError

PY = {
    "src/pay/gateway.py": "def charge(x):\n    return x\n\n\nclass Gateway:\n    def open(self):\n        return charge(1)\n",
    "src/pay/service.py": "from .gateway import charge\n\n\ndef checkout(cart):\n    return charge(cart)\n",
    "src/web/app.py": "from pay.service import checkout\n\n\n@app.post('/orders')\ndef create_order():\n    return checkout(1)\n",
    "tests/test_app.py": "from web.app import create_order\n\n\ndef test_create():\n    create_order()\n",
    "node_modules/x.py": "def charge():\n    pass\n",
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")), "p")
    e.first = e.index(frame(spark, PY))
    return e


def names(rows, bucket):
    return {(r.path, r.line, r.confidence) for r in rows if r.bucket == bucket}


def test_index_counts_and_skip(spark, engine):
    assert engine.first["files_indexed"] == 4 and engine.first["symbols_indexed"] == 6
    again = engine.index(frame(spark, PY))
    assert (again["files_indexed"], again["files_skipped"], again["edges"]) == (0, 4, engine.first["edges"])


def test_symbol_reach(engine):
    deps, touched = engine.query_symbol("pay::gateway::charge")
    rows = deps.collect()
    assert names(rows, "direct") == {("pay::gateway::Gateway::open", 6, EXACT), ("pay::service::checkout", 4, EXACT)}
    assert names(rows, "indirect") == {("web::app::create_order", 5, EXACT), ("tests::test_app::test_create", 4, EXACT)}
    via = {r.path: r.via for r in rows}
    assert via["tests::test_app::test_create"] == ["pay::service::checkout", "web::app::create_order"]
    assert [(r.contract_kind, r.contract_id) for r in touched.collect()] == [("ApiRoute", "POST /orders")]
    assert [r.path for r in report.affected_tests(deps).collect()] == ["tests::test_app::test_create"]


def test_four_ways_to_one_answer(engine):
    want = {(r.bucket, r.path) for r in engine.query_symbol("pay::gateway::charge")[0].collect()}
    for text in ("rename pay::gateway::charge", "rename charge to debit", "remove gateway::charge", "change signature of charge"):
        assert {(r.bucket, r.path) for r in engine.change(text)[0].collect()} == want


def test_diff_reaches_what_its_lines_hold(engine):
    deps, _ = engine.diff("+++ b/src/pay/service.py\n@@ -4 +5 @@\n")
    assert {r.path for r in deps.collect()} == {"web::app::create_order", "tests::test_app::test_create"}


def test_errors(spark, engine, tmp_path):
    with pytest.raises(ChangeError):
        engine.change("drop table x")
    with pytest.raises(UnresolvedError) as e:
        engine.change("remove nowhere::charge")
    assert e.value.hint == ["pay::gateway::charge"]
    with pytest.raises(NotIndexedError):
        Engine(spark, str(tmp_path), "q").query_file("a.py")


def test_lost_side_of_an_event_is_told_once(spark, tmp_path):
    event = "pub struct Paid { pub id: i32 }\nimpl Event for Paid {}\n"
    send = "use crate::event::Paid;\npub fn pay() { emit(Paid { id: 1 }); }\n"
    take = "use crate::event::Paid;\npub fn on_paid(e: Paid) { log(e); }\n"
    e = Engine(spark, str(tmp_path), "p")
    files = {"src/event.rs": event, "src/send.rs": send, "src/take.rs": take}
    assert e.index(frame(spark, files))["lost_events"] == []
    lost = e.index(frame(spark, files | {"src/send.rs": "pub fn pay() {}\n"}))["lost_events"]
    assert lost == [{"event": "Paid", "lost_producer": True, "lost_consumer": False}]
    assert e.index(frame(spark, files | {"src/send.rs": "pub fn pay() {}\n"}))["lost_events"] == []


def test_interfaces_packages_and_barrels(spark, tmp_path):
    files = {
        "svc/store.go": "package svc\n\ntype Store interface {\n\tFetch(id int) (string, error)\n}\n\nfunc use(s Store) {\n\ts.Fetch(1)\n}\n",
        "svc/db.go": "package svc\n\ntype Db struct{}\n\nfunc (d *Db) Fetch(key int) (string, error) {\n\treturn key, nil\n}\n",
        "web/a.ts": "export function help() { return 1; }\nexport default function Main() { return 2; }\n",
        "web/index.ts": "export { help as aid } from './a';\nexport * from './a';\n",
        "web/use.ts": "import Top from './a';\nimport { aid } from './index';\nexport function go1() { aid(); Top(); }\n",
        "web/detail.tsx": "export function DetailScreen() {\n  return null\n}\n",
        "web/router.tsx": "import { DetailScreen } from './detail'\nexport function AppRouter() {\n  return <Stack.Screen name={Screens.Detail} component={DetailScreen} />\n}\n",
        "web/list.tsx": "export function ListScreen({ navigation }) {\n  return navigation.navigate(Screens.Detail, { id: 1 })\n}\n",
        "core/Cargo.toml": '[package]\nname = "my-core"\n',
        "core/src/lib.rs": "pub fn shared() {}\n",
        "app/Cargo.toml": '[package]\nname = "app"\n[dependencies]\nmy-core = { path = "../core" }\n',
        "app/src/main.rs": "use my_core::shared;\nfn main() { shared(); }\n",
        "other/Cargo.toml": '[package]\nname = "other"\n',
        "other/src/lib.rs": "pub fn stranger() { shared(); }\n",
    }
    e = Engine(spark, str(tmp_path), "p")
    e.index(frame(spark, files))
    nodes = {r.id: r.qualified_path for r in e.store.read("nodes").collect()}
    edges = {(nodes[r.from_id], nodes[r.to_id], r.kind) for r in e.store.read("edges").collect()}
    assert ("svc::db::Db::Fetch", "svc::store::Store::Fetch", "Implements") in edges
    assert ("svc::store::use", "svc::store::Store::Fetch", "Calls") in edges
    assert ("web::use::go1", "web::a::help", "Calls") in edges and ("web::use::go1", "web::a::Main", "Calls") in edges
    assert ("app::src::main" in str(edges)) or any(a.endswith("main") and b.endswith("shared") for a, b, _ in edges)
    assert not any("stranger" in a and "shared" in b for a, b, _ in edges)
    assert {("web::router::route:Detail", "web::detail::DetailScreen", "References"), ("web::list::ListScreen", "web::router::route:Detail", "References")} <= edges
    reached = {r.path for r in e.query_symbol("Db::Fetch")[0].collect()}
    assert {"svc::store::Store::Fetch", "svc::store::use"} <= reached
