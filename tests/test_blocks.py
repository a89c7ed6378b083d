"""Blocks, fields, parameters and members of source texts, on fixtures and against plain walks over generated headers."""

import random

import pytest
from pyspark.sql import functions as F

from snapdelta.functions import text as tx
from snapdelta.operators import hunks
from snapdelta.sources import blocks

TS = '''import { x } from "./y";
/** Doc comment that holds { braces } and function words()
 * @param a the first
 * @param {string} [b=1] - second
 */
export async function run(a: number, { c, d }: Opts, b: Map<string, number> = new Map(), ...rest: string[]) { return { a }; }
/**/
function bare(q) {}
/** @param z */
const no = 1;
export interface Payload extends Base<{ a: 1 }> {
  id: string;
  // note: not a field
  readonly name?: string;
  nested: { a: number; b: [x, y] };
  call(x: number): void;
}
interface Empty {}
type U = "a" | "b";
type Flags = { on: boolean, cb: (x: A) => void, hidden: B };
export const Schema = z.object({ id: z.string(), n: z.number() });
const myinterface = 3;
type Open = {
  never: closed
'''
RS = "pub struct Event {\n  pub id: u64,\n  #[serde(skip)]\n  pub name: String,\n  pub(crate) hid: u8,\n  map: HashMap<String, Vec<u8>>,\n}\nstruct Unit;\nstruct P { x: f32 }\n"


def _files(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "file string, content string")


def test_shapes_of_typescript_and_rust(spark):
    files = _files(spark, a_ts=TS, b_rs=RS, c_txt="interface X { a: b }", d_ts="")
    got = {(r.file, r.type_name): r.fields for r in blocks.shapes(files).collect()}
    # the brace of "extends Base<{" is the first behind the keyword, so Payload holds what that one holds
    assert got[("a.ts", "Payload")] == ["a"]
    assert got[("a.ts", "Empty")] == []
    # the alias without braces takes the braces that come next; behind an arrow nothing is split
    assert got[("a.ts", "U")] == ["cb", "on"]
    assert got[("a.ts", "Schema")] == ["id"]
    assert ("a.ts", "Flags") not in got and ("a.ts", "Open") not in got
    assert got[("b.rs", "Event")] == ["id", "map", "name"]
    assert got[("b.rs", "Unit")] == ["x"] and ("b.rs", "P") not in got  # a struct without braces takes the next ones, too
    assert not [k for k in got if k[0] in ("c.txt", "d.ts")]


def test_shapes_plain_interface(spark):
    src = "export interface Payload {\n  id: string;\n  name?: string;\n  nested: { a: number };\n}\n"
    (r,) = blocks.shapes(_files(spark, a_ts=src)).collect()
    assert (r.type_name, r.fields) == ("Payload", ["id", "name", "nested"])


def test_documented_functions_and_drift(spark):
    drift = blocks.documented_parameters(_files(spark, a_ts=TS))
    got = {r.fn: (r.doc_params, r.sig_params) for r in drift.collect()}  # not the constant's
    assert got == {"run": (["a", "b"], ["a", "b", "rest"]), "bare": ([], ["q"])}
    assert [x.drift for x in hunks.docs_drift(drift).collect()] == ["param-count"]


def test_documented_function_kinds(spark):
    src = "/**\n * @param a foo\n * @param b bar\n */\nexport function run(a: number, c: string) {}\n/** @param a x */ function ok(a) {}\n/** @param a x */\nlet y; function no(b) {}"
    got = {r.fn: (r.doc_params, r.sig_params) for r in blocks.documented_parameters(_files(spark, a_ts=src)).collect()}
    assert got == {"run": (["a", "b"], ["a", "c"]), "ok": (["a"], ["a"])}


def test_members_functions_unions(spark):
    src = '''// class Commented { no() {} }
export abstract class Greeter<T> extends Base {
  private n = 0;
  url = "http://x//{";
  handler = (e: Event) => { this.greet(e); };
  constructor(private readonly name: string) { super(); }
  public async greet(
    who: string,
    { loud }: Opts,
  ): Promise<string> {
    if (loud) { return inner(who); }
    return who;
  }
  static of<U>(x: U): Greeter<U> { return new Greeter(x); }
  get size(): number { return 1; }
}
interface Shape { area(scale: number): number; name: string }
export function top(
  a: number,
  b: string,
): void {
  class Local { m() {} }
}
export type Mode =
  | "on"
  | 'off'
  | "it";
type Alias = "a" | Other;
'''
    files = _files(spark, a_ts=src)
    got = {r.name: (r.exported, r.signature) for r in blocks.members(files).collect()}
    assert set(got) == {"Greeter.constructor", "Greeter.greet", "Greeter.of", "Greeter.size", "Shape.area"}
    assert got["Greeter.greet"] == (True, "public async greet( who: string, { loud }: Opts, ): Promise<string>")
    assert got["Shape.area"] == (False, "area(scale: number): number")
    (f,) = blocks.functions(files).collect()
    assert (f.name, f.exported, f.signature) == ("top", True, "function top( a: number, b: string, ): void")
    assert [(r.name, r.exported, r.variants) for r in blocks.unions(files).collect()] == [("Mode", True, ["on", "off", "it"])]
    all_ = blocks.all_declarations(files)
    kinds = {r.name: r.kind for r in all_.collect()}
    assert kinds["Mode"] == "state" and kinds["Greeter"] == "type" and kinds["Greeter.of"] == "function"
    edges = {(r.dst, r.kind) for r in blocks.containment_edges(all_).collect()}
    assert ("a.ts#Greeter.of", "exports") in edges and ("a.ts#Shape.area", "defines") in edges and ("a.ts#Shape.area", "exports") not in edges


def _walk_pairs(text):
    stack, out = [], {}
    for i, c in enumerate(text, 1):
        if c == "{":
            stack.append(i)
            out[i] = (None, len(stack), stack[-2] if len(stack) > 1 else None)
        elif c == "}":
            if stack:
                o = stack.pop()
                out[o] = (i, *out[o][1:])
    return out


def test_brackets_and_enclosing_against_a_stack(spark):
    rng = random.Random(3)
    texts = {f"f{i}_x": "".join(rng.choice("{}ab\u0001é") for _ in range(rng.randint(0, 60))) for i in range(200)}
    for k in list(texts):  # a closer too many moves the levels below zero; the stack above knows no such thing
        depth, kept = 0, ""
        for c in texts[k]:
            depth += {"{": 1, "}": -1}.get(c, 0)
            if depth < 0:
                depth = 0
                continue
            kept += c
        texts[k] = kept
    pairs = blocks.brackets(_files(spark, **texts), r"\{", r"\}")
    got = {}
    for r in blocks.enclosing(pairs).collect():
        got.setdefault(r.file, {})[r.open_at] = (r.close_at, r.depth, r.parent_at)
    for name, text in texts.items():
        want = _walk_pairs(text)
        want = {o: (c, d, p if p and want[p][0] else None) for o, (c, d, p) in want.items()}
        assert got.get(name.replace("_", "."), {}) == want, text


def _walk_parts(text, separators):
    depth, start, out = 0, 0, []
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c in separators and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


@pytest.mark.parametrize("separators", [",", ";,\n"])
def test_depth_zero_parts_of_generated_headers(spark, separators):
    rng = random.Random(5)
    bits = ["a: number", "b?: Map<string, X>", "{ c, d }: O", "...rest: T[]", "fn: (x: A) => void", "readonly e", " pub f: u8 ", "", "g = h(1, 2)", "\n", "[k: string]: v", "// note"]
    rows = [(i, rng.choice([", ", ",", ";", ";\n"]).join(rng.choices(bits, k=rng.randint(0, 6)))) for i in range(10_000)]
    escaped = separators.replace("\n", r"\n")
    got = {}
    for r in blocks.parts_at_depth_zero(spark.createDataFrame(rows, "id long, body string"), ("id",), "body", escaped).collect():
        got.setdefault(r.id, {})[r.part] = r.fragment
    for i, text in rows:
        assert [got[i][k] for k in sorted(got[i])] == _walk_parts(text, separators), text


def test_field_and_parameter_names(spark):
    frags = {"  pub readonly a?: x": "a", "readonly [k: s]": None, "b": "b", "c(x): y": None, "// d": None, "#[e]": None, "pub fn": None, "é: x": None, "f!: x": None, "": None, "where x": None}
    rows = spark.createDataFrame(list(frags.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.select("want", blocks.field_name(F.col("t")).alias("got")).collect())
    params = {"a: x": "a", "...rest: T[]": "rest", "{ a, b }: O": None, "[x]": None, "b = 1": "b", "c?": "c", "": None, " _d ": "_d", "9": None}
    rows = spark.createDataFrame(list(params.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.select("want", blocks.parameter_name(F.col("t")).alias("got")).collect())


def test_doc_params(spark):
    text = "/**\n * @param a first\n * @param {T} [b=1] x\n@param\tc? y\n * @param {broken d\n * @paramount\n * @param e:f\n */"
    (r,) = spark.createDataFrame([(text,)], "t string").select(tx.doc_params(F.col("t")).alias("x")).collect()
    assert r.x == ["a", "b", "c", "ount", "e"]


def test_no_rows(spark):
    none = spark.createDataFrame([("a.ts", None), ("b.ts", "")], "file string, content string")
    for f in (blocks.shapes, blocks.documented_parameters, blocks.members, blocks.functions, blocks.unions, blocks.all_declarations):
        assert f(none).count() == 0


def test_transition_literals(spark):
    src = 'if (a.b === "x") { if (q) { r("}"); s = "y"; } const t = "no"; return "z" }\nelse if ("y" == a) return "x"; return "w";\nif (a === "x" && b) { return "n"; }\nif (a == "z") {\n // return "c"\n u["k"] = "y", v == "n";\n}\nif (a === "last") return "one"'
    got = sorted((r["from"], r["to"]) for r in blocks.transition_literals(_files(spark, a_ts=src)).collect())
    assert got == [("last", "one"), ("x", "y"), ("x", "z"), ("y", "x"), ("z", "y")]
