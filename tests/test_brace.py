from weftgraph.operators import go_graph
from weftgraph.sources import brace_facts

JAVA = '''package p;
/** Does work. */
@Service
public class Worker extends Base implements Runnable, Closeable {
    private int n = 1; // class Fake {
    public int run(String name, int k) {
        if (k > 1 && n == 2) { return 1; }
        return "class X {".length();
    }
    static class Inner { void go() {} }
}
interface Shape { int area(); }
enum Color { RED }
'''
TS = '''export class Store extends Base {
  static async load(id: string): Promise<Item> { if (id && true) { return null; } }
  get size() { return 1; }
}
export interface Item { id: string }
enum Mode { On }
const double = (x: number) => { return x * 2; };
function* walk(a) { for (const b of a) { yield b; } }
const { a, b: c } = props;
let limit = 3;
export { limit };
type Alias = string | number;
'''
GO = '''package shop

import (
	"fmt"
	log "github.com/x/log"
)

type Base struct{}

type Cart struct {
	Base
	Items []*Item `json:"items"`
	Meta struct {
		Name string
	}
}

type Item struct { Price int }

type Pricer interface {
	Total(tax int) (int, error)
}

const (
	Low Level = iota
	High
)

var Default Cart

func New(n int) *Cart {
	c := &Cart{}
	go audit(n)
	return c
}

func (c *Cart) Total(tax int) (int, error) {
	fmt.Println("func fake() {")
	return helper(tax), nil
}

func helper(x int) int { return x }
func audit(n int) {}
'''


def test_java():
    got = {(e["kind"], e["parent_name"], e["name"]): e for e in brace_facts.entities_of("a/W.java", JAVA)}
    assert set(got) == {("Class", "", "Worker"), ("Method", "Worker", "run"), ("Class", "Worker", "Inner"), ("Method", "Worker/Inner", "go"), ("Interface", "", "Shape"), ("Method", "Shape", "area"), ("Enum", "", "Color")}
    w, run = got["Class", "", "Worker"], got["Method", "Worker", "run"]
    assert w["is_exported"] and w["modifiers"] == ["@Service", "public"] and w["description"] == "Does work.\nSuperclass: Base\nImplements: Runnable, Closeable"
    assert "Parameters: String name, int k" in run["description"] and run["complexity"] >= 3 and run["line"] == 6


def test_typescript():
    got = {(e["kind"], e["parent_name"], e["name"]): e for e in brace_facts.entities_of("s.ts", TS)}
    assert {("Class", "", "Store"), ("Method", "Store", "load"), ("Method", "Store", "size"), ("Interface", "", "Item"), ("Enum", "", "Mode"), ("Method", "", "double"), ("Method", "", "walk"), ("Variable", "", "a, b"), ("Variable", "", "limit"), ("Variable", "", "Alias")} <= set(got)
    assert got["Class", "", "Store"]["is_exported"] and got["Variable", "", "limit"]["is_exported"] and got["Method", "Store", "load"]["modifiers"] == ["static", "async"]


def test_entities_in_spark(spark):
    files = spark.createDataFrame([("W.java", JAVA), ("s.ts", TS), ("x.py", "class A: pass"), ("e.js", None)], "file_path string, content string")
    assert {r.language for r in brace_facts.brace_entities(files).collect()} == {"java", "typescript"}


def test_go_graph(spark):
    nodes, edges = go_graph.typed_graph(spark.createDataFrame([("/r/shop/cart.go", GO)], "file_path string, content string"))
    names = {(r.type, r["name"]) for r in nodes.collect()}
    assert {("package", "shop"), ("file", "cart.go"), ("struct", "Cart"), ("struct", "Cart.Meta"), ("interface", "Pricer"), ("function", "New"), ("function", "Cart.Total"), ("field", "Cart.Items"), ("interface_func", "Pricer.Total"), ("enum", "High"), ("import", "github.com/x/log"), ("variable", "Default")} <= names
    short = lambda i: i.split(":")[1]
    got = {(short(r.source_id), r.relation_type, short(r.target_id)) for r in edges.collect()}
    assert {("New", "calls", "audit"), ("New", "instantiates", "Cart"), ("Cart.Total", "calls", "helper"), ("Cart", "extends", "Base"), ("Cart", "has_method", "Cart.Total"), ("Cart", "has_field", "Cart.Items"), ("Cart.Items", "references", "Item"), ("shop", "has_function", "New"), ("cart.go", "has_import", "fmt"), ("Default", "references", "Cart"), ("shop", "has_struct", "Item")} <= got
    assert not any("fake" in i for e in got for i in e)
