"""Adapters on one file each: symbols and references, without Spark."""

from __future__ import annotations

import pytest

from ripplegraph.extract import braces


def refs(x, kind=None):
    return {(r.source, r.name, r.tag, r.module) for r in x.refs if kind in (None, r.kind)}


RUST = """use crate::store::Repo;
use crate::mail::Mailer;
pub struct Shop { repo: Arc<Repo>, mail: Option<Box<Mailer>>, size: u32 }
impl Shop {
    pub fn buy(&self) { self.repo.save(1); self.mail.send(); self.size.pow(2); }
}
fn direct(a: &Repo) {
    a.load();
    let m = Mailer::new(1);
    m.send();
    let r: Arc<Repo> = make();
    r.save(2);
    let u = other();
    u.save(3);
}
"""


def test_rust_receivers_have_the_types_of_fields_parameters_and_bindings():
    calls = refs(braces.rust("src/shop.rs", "shop", RUST), "Calls")
    assert {("shop::Shop::buy", "Repo::save", "Module", "store"), ("shop::Shop::buy", "Mailer::send", "Module", "mail")} <= calls
    assert {("shop::direct", "Repo::load", "Module", "store"), ("shop::direct", "Mailer::send", "Module", "mail"), ("shop::direct", "Repo::save", "Module", "store")} <= calls
    assert ("shop::direct", "save", "Opaque", "") in calls and not any("u32" in str(c) for c in calls)


@pytest.mark.parametrize(("text", "want"), [("&'a mut Repo", "Repo"), ("Arc<Repo>", "Repo"), ("Option<Box<x::Repo>>", "Repo"), ("Map<Key, Value>", "Key"), ("Arc<u8>", "Arc"), ("u32", None), ("&str", None)])
def test_rust_types(text, want):
    assert braces._rust_type(text) == want


ROUTER = """import { DetailScreen } from './detail'
import { SettingsScreen } from './settings'
export function AppRouter() {
  return (
    <Stack.Screen name={Screens.Detail} options={{ title: 'x' }} component={DetailScreen} />
    <Stack.Screen name="Settings" component={SettingsScreen} />
    <Stack.Screen name="Callback">{() => <Foo />}</Stack.Screen>
  )
}
"""


def test_routes_refer_to_their_components():
    x = braces.script("router.tsx", "router", ROUTER)
    assert {(s.path, s.line) for s in x.symbols if "route:" in s.path} == {("router::route:Detail", 5), ("router::route:Settings", 6)}
    assert {("router::route:Detail", "DetailScreen", "Module", "detail"), ("router::route:Settings", "SettingsScreen", "Module", "settings")} <= refs(x, "References")
    assert not any("route:" in s.path for s in braces.script("router.spec.tsx", "router.spec", ROUTER).symbols)


def test_routes_of_a_screens_object():
    text = "import { A, B } from './s'\nconst n = make({ screens: { One: { screen: A, options: { x: 1 } }, 'Two': B, Three: { options } }, screen: B })\n"
    x = braces.script("n.ts", "n", text)
    assert {("n::route:One", "A", "Module", "s"), ("n::route:Two", "B", "Module", "s")} == {r for r in refs(x) if "route:" in r[0]}


def test_navigation_names_its_route():
    text = """export const back = (navigation) => navigation.popTo(Screens.Detail)
export function open(navigation) { navigation.navigate('Settings', { id: 1 }) }
export function held() { this.props.navigation.push("Detail"); navigate(Screens.Home); }
export function not(tags, history) { tags.push('Settings'); history.push(x.y); navigation.navigate(name); navigation.navigate(`a`) }
"""
    named = {(r.source, r.name) for r in braces.script("a.ts", "a", text).refs if r.name.startswith("route:")}
    assert named == {("a::back", "route:Detail"), ("a::open", "route:Settings"), ("a::held", "route:Detail"), ("a::held", "route:Home")}


def test_proxy_traps_are_neither_symbols_nor_calls():
    text = "export function wrap(t) {\n  return new Proxy(t, {\n    get(target, key) { return read(target, key); },\n    apply(f, self) { return 1; },\n  });\n}\n"
    x = braces.script("p.ts", "p", text)
    assert {s.path for s in x.symbols} == {"p::<module>", "p::wrap"}
    assert {r.name for r in x.refs if r.kind == "Calls"} == {"Proxy", "read"}


GO = """package consumer

import "example.com/app/source"

type Deps struct {
\tSvc source.Service
}

type Store interface {
\tSave(svc *source.Service) error
}

func Handle(svc *source.Service) bool { return svc != nil }

func Build() *source.Service { return nil }

func Default() string {
\tsvc := source.Service{Name: "d"}
\treturn svc.Name
}

func Unrelated() string { return "source.Service" }
"""


def test_go_refers_to_imported_types():
    named = {r[0] for r in refs(braces.go("consumer/handler.go", "consumer::handler", GO), "References") if r[1:] == ("Service", "Module", "example.com::app::source")}
    assert {p.rsplit("::", 1)[-1] for p in named} == {"Deps", "Store", "Handle", "Build", "Default"}


def test_go_generated_marker():
    assert braces.go("a.go", "a", "// Code generated by x. DO NOT EDIT.\npackage a\n").generated
    assert not braces.go("a.go", "a", "// Code generated by hand\npackage a\n").generated
