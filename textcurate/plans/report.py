"""A Markdown report of small summaries; parts without data say so."""

from __future__ import annotations

from typing import Any

from ..operators.evaluation import MEMORISATION
from ..sources.files import dig, read_json

DASH = "—"


def number(value: Any, places: int = 3) -> str:
    if value is None:
        return DASH
    return f"{value:.{places}f}" if isinstance(value, float) else str(value)


def delta(base: float | None, tuned: float | None, places: int = 3) -> str:
    return DASH if base is None or tuned is None else f"{tuned - base:+.{places}f}"


def duration(seconds: float | None) -> str:
    if seconds is None:
        return DASH
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{s}s"


def snippet(text: str, n: int = 60) -> str:
    return text[:n].replace("|", "\\|").replace("\n", " ")


def table(rows: list[dict], columns: list[str]) -> str:
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join(number(r.get(c)) for c in columns) + " |" for r in rows)])


def build(sections: dict[str, list[dict] | None]) -> str:
    """One heading a section with a table of its rows, or a note that they are missing."""
    out = ["# RESULTS"]
    for title, rows in sections.items():
        out.append(f"\n## {title}\n")
        out.append(table(rows, list(rows[0])) if rows else "_no data yet_")
    return "\n".join(out) + "\n"


def _grid(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(r) + " |" for r in ([*([head]), ["---"] * len(head), *rows])])


def split_section(split_report: dict | None, types: list[str]) -> str | None:
    """Rows of each split and type, and how they were made."""
    if not split_report:
        return None
    rows = [[s, *(number(dig(split_report, t, s)) for t in types)] for s in ("train", "val", "test")]
    made = "; ".join(f"{k}: {number(dig(split_report, '_meta', k))}" for k in ("split_strategy", "min_chars", "max_samples", "input_source"))
    return f"{_grid(['split', *types], rows)}\n\n{made}"


def training_section(manifests: dict[str, dict | None], types: list[str]) -> str | None:
    """What each adapter was trained with, and its losses and time."""
    if not any(manifests.get(t) for t in types):
        return None
    hyper = ("lora_r", "lora_alpha", "lora_dropout", "learning_rate", "num_train_epochs", "per_device_train_batch_size", "gradient_accumulation_steps", "max_seq_length")
    lines = [("base_model", ("base_model",), 3), *((k, ("hyperparams", k), 6) for k in hyper), ("train_samples", ("train_samples",), 0), ("val_samples", ("val_samples",), 0)]
    lines += [("train_loss", ("metrics", "train_loss"), 4), ("eval_loss", ("metrics", "eval_loss"), 4), ("peak_vram_gb", ("metrics", "peak_vram_gb"), 2)]
    rows = [[name, *(number(dig(manifests.get(t), *path), places) for t in types)] for name, path, places in lines]
    rows.append(["duration", *(duration(dig(manifests.get(t), "duration_seconds")) for t in types)])
    rows.append(["timestamp_utc", *(str(dig(manifests.get(t), "timestamp_utc") or DASH)[:19] for t in types)])
    return _grid(["parameter", *types], rows)


def comparison_section(base: dict | None, tuned: dict | None, types: list[str]) -> str | None:
    """Style, meaning and distribution before and after, and whether every type won.

    A type wins if its style accuracy and MAUVE rose and its mean cosine did not fall by more than 0.05.
    """
    if not base and not tuned:
        return None
    metrics = {"style_accuracy": ("style", "style_accuracy"), "style_confidence": ("style", "style_confidence"), "cosine_mean": ("cosine", "mean"), "mauve": ("mauve", "mauve")}
    pair = lambda t, m: (dig(base, t, *metrics[m]), dig(tuned, t, *metrics[m]))
    head = ["metric", *(f"{t} {x}" for t in types for x in ("before", "after", "change"))]
    rows = [[m, *(x for t in types for x in (number(pair(t, m)[0]), number(pair(t, m)[1]), delta(*pair(t, m))))] for m in metrics]
    verdicts = []
    for t in types:
        (a, b), (c, d), (e, f) = pair(t, "style_accuracy"), pair(t, "cosine_mean"), pair(t, "mauve")
        known = None not in (a, b, c, d, e, f)
        verdicts.append(f"{t}: " + (("better" if b > a and f > e and d >= c - 0.05 else "not better") if known else DASH))
    return f"{_grid(head, rows)}\n\n{'; '.join(verdicts)}"


def confusion_section(confusions: dict[str, list[dict] | None]) -> str | None:
    """For each named model, shares of predicted classes by actual class and their mean diagonal."""
    if not any(confusions.values()):
        return None
    out = []
    for name, rows in confusions.items():
        out.append(f"### {name}\n")
        if not rows:
            out.append("_no data yet_\n")
            continue
        classes = [k[3:] for k in rows[0] if k.startswith("to_")]
        key = next(k for k in rows[0] if k != "n" and not k.startswith("to_"))
        out.append(_grid(["", *(f"to {c}" for c in classes)], [[f"{r[key]} (n={r['n']})", *(f"{100 * (r[f'to_{c}'] or 0):.1f}%" for c in classes)] for r in rows]))
        own = [r[f"to_{r[key]}"] or 0 for r in rows if f"to_{r[key]}" in r]
        out.append(f"\nMean diagonal {100 * sum(own) / max(len(own), 1):.1f}%, by chance {100 / max(len(classes), 1):.1f}%\n")
    return "\n".join(out)


def memorisation_section(found: dict[str, dict | None], nearest: dict[str, list[dict]] | None = None) -> str | None:
    """The five nearest texts of each type and the verdict on its memorisation_summary."""
    if not any(found.values()):
        return None
    out, m = [], MEMORISATION
    for t, s in found.items():
        out.append(f"### {t}\n")
        if not s:
            out.append("_no data yet_\n")
            continue
        near = (nearest or {}).get(t, [])[:5]
        if near:
            line = lambda r: [
                snippet(str(r.get("generated", r.get("query_id")))), str(r["nearest_id"]), f"{r['fuzz_ratio']:.1f}", f"{r['jaccard_5gram']:.3f}", str(r["longest_common_chars"])
            ]
            out.append(_grid(["text", "nearest", "ratio", "5-gram Jaccard", "run"], [line(r) for r in near]) + "\n")
        tests = [("median ratio", s["fuzz_median"], m["median_below"]), ("largest ratio", s["fuzz_max"], m["max_below"]), ("longest run", s["run_max"], m["run_below"])]
        out += [f"{name}: {number(float(v), 1)} (below {limit:g}: {'yes' if v < limit else 'no'})" for name, v, limit in tests]
        out.append(f"\n**{'PASS' if all(v < limit for _, v, limit in tests) else 'FAIL'}**\n")
    return "\n".join(out)


def results(
    types: list[str], split_report: dict | None = None, manifests: dict[str, dict | None] | None = None, base: dict | None = None, tuned: dict | None = None,
    confusions: dict[str, list[dict] | None] | None = None, memorisation: dict[str, dict | None] | None = None, nearest: dict[str, list[dict]] | None = None, notes: list[str] | None = None,
) -> str:
    """The report of a whole run in six numbered sections, whatever of it is there."""
    parts = {
        "Data and split": split_section(split_report, types), "Training": training_section(manifests or {}, types), "Before and after": comparison_section(base, tuned, types),
        "Separation of types": confusion_section(confusions or {}), "Memorisation": memorisation_section(memorisation or {}, nearest),
        "Simplifications": "\n".join(f"- {n}" for n in notes or []) or None,
    }
    return "# RESULTS\n" + "".join(f"\n## {i}. {title}\n\n{body or '_no data yet_'}\n" for i, (title, body) in enumerate(parts.items(), 1))


def results_from(types: list[str], split_report: str, base: str, tuned: str, manifests: dict[str, list[str]], **more) -> str:
    """results() of artefacts by path; the first manifest that is there counts for its type, missing files are left out."""
    first = lambda paths: next((m for m in map(read_json, paths) if m is not None), None)
    whole = lambda folder: {"summary": read_json(f"{folder}/eval_summary.json"), "confusion": read_json(f"{folder}/cross_type_confusion.json")}
    a, b = whole(base), whole(tuned)
    flat = lambda c: [r for rows in c.values() for r in rows] if c else None
    return results(types, read_json(split_report), {t: first(p) for t, p in manifests.items()}, a["summary"], b["summary"], {"before": flat(a["confusion"]), "after": flat(b["confusion"])}, **more)
