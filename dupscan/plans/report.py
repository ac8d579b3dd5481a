"""Reports of a detection: text, JSON and SARIF, streamed group by group.

Totals come from an aggregate.  Rows reach the driver in report order, a partition at a time, and each piece of a report is
handed on before the next is made, so neither the number of groups nor that of instances is bounded here."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

from dupscan import __version__
from dupscan.config import DetectionConfig
from dupscan.plans.detector import Detection, total_clones

FIELDS = ("path", "start_line", "start_col", "end_line", "end_col", "content")


def streamed(found: Detection) -> Iterator[tuple[dict, Iterator[dict]]]:
    """(group, its instances): equal windows by size, then similar files where the mode looks for them."""
    from pyspark.sql import functions as F

    heads = found.groups.select("sig", "clone_type", "similarity", "size", "avg_lines")
    rows = found.instances.select("sig", *FIELDS, "start").join(heads, "sig").orderBy(F.desc("size"), "sig", "path", "start_line", "start")
    every = (r.asDict() for r in rows.toLocalIterator())
    if found.config.finds_similar:
        every = chain(every, (r.asDict() for r in found.similar_instances.orderBy(F.desc("similarity"), "sig", "path").toLocalIterator()))
    for _, own in groupby(every, key=lambda r: r["sig"]):
        first = next(own)
        yield {k: first[k] for k in ("sig", "clone_type", "similarity", "size", "avg_lines")}, ({k: r[k] for k in FIELDS} for r in chain([first], own))


def collected(found: Detection) -> list[dict]:
    """All groups with their instances, in report order."""
    return [group | {"instances": list(own)} for group, own in streamed(found)]


def totals(found: Detection) -> dict:
    """Groups and instances of the whole detection."""
    row = total_clones(found.groups).first().asDict()
    if found.config.finds_similar:
        n = found.similar.count()
        row = {"groups": row["groups"] + n, "instances": row["instances"] + 2 * n}
    return row


def settings(config: DetectionConfig, form: str) -> list[str]:
    return [f"settings: mode={config.mode.value} tokens>={config.min_tokens} lines>={config.min_lines} similarity>={config.similarity_threshold:g} output={form}"]


def text_report(groups: Iterable[tuple[dict, Iterable[dict]]], total: dict, verbose: bool = False) -> Iterator[str]:
    """Lines of the report."""
    yield f"clones: {total['groups']} groups, {total['instances']} places" if total["groups"] else "clones: none"
    for number, (g, own) in enumerate(groups, 1):
        alike = "" if g["similarity"] == 1 else f", {g['similarity']:.3f} alike"
        yield f"[{number}] {g['clone_type']}: {g['size']} places of {g['avg_lines']:.1f} lines{alike}"
        for x in own:
            yield f"  {x['path']} lines {x['start_line']}-{x['end_line']} columns {x['start_col']}-{x['end_col']}"
            if verbose:
                lines = x["content"].splitlines()
                yield from (f"  | {line}" for line in lines[:3])
                if len(lines) > 3:
                    yield f"  | ({len(lines) - 3} more lines)"


def _list(entries: Iterable[str]) -> Iterator[str]:
    for k, entry in enumerate(entries):
        yield (",\n" if k else "\n") + entry


def json_report(groups: Iterable[tuple[dict, Iterable[dict]]], total: dict, files: int | None = None, seconds: float | None = None) -> Iterator[str]:
    """Pieces of one JSON object."""
    head = {"total_groups": total["groups"], "total_instances": total["instances"]} | ({} if files is None else {"files_analyzed": files}) | ({} if seconds is None else {"duration_ms": round(1000 * seconds)})
    yield json.dumps(head)[:-1] + ', "groups": ['
    yield from _list(json.dumps({"signature": g["sig"], **{k: g[k] for k in ("clone_type", "similarity", "size", "avg_lines")}, "instances": list(own)}, ensure_ascii=False) for g, own in groups)
    yield "\n]}"


def sarif_report(groups: Iterable[tuple[dict, Iterable[dict]]]) -> Iterator[str]:
    """Pieces of one log in the Static Analysis Results Interchange Format 2.1.0: a result for each group, its first
    instance as the location."""

    def place(x: dict) -> dict:
        region = {"startLine": x["start_line"], "startColumn": x["start_col"] + 1, "endLine": x["end_line"], "endColumn": x["end_col"] + 1}
        return {"physicalLocation": {"artifactLocation": {"uri": x["path"]}, "region": region}}

    def result(g: dict, own: Iterable[dict]) -> str:
        places = [place(x) for x in own]
        return json.dumps({"ruleId": g["clone_type"], "level": "warning", "message": {"text": f"{g['size']} instances of a duplicated passage"}, "partialFingerprints": {"signature": g["sig"]}, "locations": places[:1], "relatedLocations": places[1:]}, ensure_ascii=False)

    driver = {"name": "dupscan", "version": __version__, "rules": [{"id": f"Type-{k}"} for k in (1, 2, 3)]}
    yield f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {json.dumps({"driver": driver})}, "results": ['
    yield from _list(result(g, own) for g, own in groups)
    yield "\n]}]}"
