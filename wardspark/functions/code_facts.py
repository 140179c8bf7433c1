"""Facts about Python sources: calls, imports and assignments, in the order the code is read."""

import ast
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf

from wardspark.functions.slices import looks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTS = (
    "struct<"
    "calls:array<struct<seq:int,line:int,col:int,func:string,first_arg_kind:string,first_arg_src:string,kwargs:map<string,string>,resolved_name:string,torch_seen:boolean>>,"
    "imports:array<struct<seq:int,local_name:string,full_name:string,module:string>>,"
    "assigns:array<struct<seq:int,line:int,col:int,target:string,value_src:string>>>"
)
_ARROW = pa.struct([
    ("calls", pa.list_(pa.struct([
        ("seq", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("func", pa.string()),
        ("first_arg_kind", pa.string()), ("first_arg_src", pa.string()), ("kwargs", pa.map_(pa.string(), pa.string())),
        ("resolved_name", pa.string()), ("torch_seen", pa.bool_()),
    ]))),
    ("imports", pa.list_(pa.struct([
        ("seq", pa.int32()), ("local_name", pa.string()), ("full_name", pa.string()), ("module", pa.string()),
    ]))),
    ("assigns", pa.list_(pa.struct([
        ("seq", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("target", pa.string()), ("value_src", pa.string()),
    ]))),
])


def _source(node) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return ""


def _dotted(func) -> str:
    """The called name as written: a plain name, or attributes behind whatever they belong to; that part is left out unless it is a name."""
    if isinstance(func, ast.Name):
        return func.id
    if not isinstance(func, ast.Attribute):
        return ""
    owner = _dotted(func.value)
    return f"{owner}.{func.attr}" if owner else func.attr


def facts_of(code: str | None) -> dict | None:
    """The facts of one source text; None where it is no Python, or nested too deeply. Running out of memory fails the task."""
    if code is None:
        return None
    try:
        return _facts(ast.parse(code))
    except (SyntaxError, ValueError, RecursionError):
        return None


def _reading_order(tree: ast.AST) -> list[tuple[ast.AST, bool]]:
    """All nodes in the order the code is read, each with whether it stands in an f-string."""
    nodes, pending = [], [(tree, False)]
    while pending:  # children are stacked in reverse
        node, quoted = pending.pop()
        nodes.append((node, quoted))
        quoted = quoted or isinstance(node, ast.JoinedStr)
        pending.extend((child, quoted) for child in reversed(list(ast.iter_child_nodes(node))))
    return nodes


def _stand_in(call: ast.Call) -> None:
    """Turns a call into a name that reads like it, so that calls around it do not write it out once more. A call never needs brackets, nor does a name."""
    source = _source(call)
    if source:
        call.__class__ = ast.Name
        call.id, call.ctx = source, ast.Load()


def _facts(tree: ast.AST) -> dict:
    """One walk down for names: an index of the imports read so far tells what a call's name stands for. One walk back up for sources:
    inner calls come first, and outer ones take over what was written for them."""
    calls, imports, assigns = [], [], []
    full_names, torch_seen, sources = {}, False, []
    for seq, (node, quoted) in enumerate(_reading_order(tree), 1):
        if isinstance(node, ast.Call):
            func, first = _dotted(node.func), node.args[0] if node.args else None
            calls.append({
                "seq": seq, "line": node.lineno, "col": node.col_offset, "func": func, "first_arg_kind": type(first).__name__ if first is not None else "",
                "resolved_name": func if "." in func else full_names.get(func, func), "torch_seen": torch_seen,
            })
            sources.append((node, calls[-1], quoted))
        elif isinstance(node, ast.Import):
            for alias in node.names:
                imports.append({"seq": seq, "local_name": alias.asname, "full_name": alias.name, "module": alias.name})
        elif isinstance(node, ast.ImportFrom):
            module = node.module or ""
            for alias in node.names:
                full = f"{module}.{alias.name}" if module else alias.name
                imports.append({"seq": seq, "local_name": alias.asname or alias.name, "full_name": full, "module": module})
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    assigns.append({"seq": seq, "line": node.lineno, "col": target.col_offset, "target": target.id})
                    sources.append((node, assigns[-1], quoted))
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for entry in imports[-len(node.names) :]:
                full_names[entry["local_name"]] = entry["full_name"]
                torch_seen = torch_seen or entry["module"] == "torch"
    for node, fact, quoted in reversed(sources):
        if isinstance(node, ast.Assign):
            fact["value_src"] = _source(node.value)
        else:
            fact["first_arg_src"] = _source(node.args[0]) if node.args else ""
            fact["kwargs"] = [(k.arg, _source(k.value)) for k in node.keywords if k.arg]
            if not quoted:  # in an f-string quotes depend on what is inside
                _stand_in(node)
    return {"calls": calls, "imports": imports, "assigns": assigns}


def facts_array(texts: Iterable[str | None]) -> pa.Array:
    """The facts of some source texts, in their order; they are read one at a time."""
    return pa.array([facts_of(text) for text in texts], type=_ARROW)


def code_facts_udf():
    @arrow_udf(returnType=FACTS)
    def code_facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for code in batches:
            for part in looks(code):
                yield facts_array(text.as_py() for text in part)

    return code_facts
