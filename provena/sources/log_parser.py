"""A second reading of wafer logs, line by line as a table function, to hold the plan of wafer_parse against.

It shares no expression with that plan: a small state machine goes over the lines of one log in their order. Logs are
partitions of its table argument, so that Spark deals whole logs to tasks and feeds each one's lines in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import col, udtf

OUT = "lot string, wafer string, device string, x int, y int, bin int, first_line long, last_line long, outcome string, tests array<struct<number:int,status:string,current:string,pins:array<string>,halt_vector:int>>"
FAILURES = {100: "CONTINUITY_FAIL", 210: "IDD_STATIC_FAIL", 606: "SCAN_FAIL"}
KINDS = {("100", "Open/Short-"): 100, ("210", "IDD_Static"): 210, ("606", "SCAN"): 606}


def _value(line: str, label: str) -> str | None:
    """The word behind a label and its colon."""
    before, colon, rest = line.partition(label + ":")
    return rest.split()[0] if colon and (not before or before[-1].isspace()) and rest.split() else None


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdecimal() else None


class LogParser:
    """Lines of one log in, one row for each device block out."""

    def __init__(self):
        self.block: dict | None = None

    def eval(self, line: Row) -> Iterator[tuple]:
        text, number = line["line"], line["line_no"]
        words = text.split()
        if not words or words[0].startswith("Wafer:") or text.strip().startswith("End of Wafer:"):
            return
        if words[0].startswith("Lot:"):
            if self.block:
                yield self._row()
            self.block = {"lot": line["lot"], "wafer": line["wafer"], "first": number, "device": None, "place": (None, None), "bin": None, "tests": [], "pins": False}
        if not self.block:
            return
        b = self.block
        b["last"] = number
        if device := _value(text, "Device"):
            b["device"] = f"D{device}"
        if kind := KINDS.get(tuple(words[:2])):
            amounts = [w for w, unit in zip(words, words[1:], strict=False) if unit == "ma"]
            b["tests"].append({"number": kind, "failed": False, "current": amounts[1] if len(amounts) == 3 else None, "pins": [], "halt": None})
            b["pins"] = False
        test = b["tests"][-1] if b["tests"] else None
        if words[0].startswith("Bin:"):
            b["bin"], b["pins"] = _whole(_value(text, "Bin")), False
            inside = text.partition("(")[2].partition(")")[0].split(",")
            if "Wafer Coordinates:" in text and len(inside) == 2:
                b["place"] = tuple(_whole(c.strip()) for c in inside)
        elif test:
            test["failed"] |= "(F)" in text
            if (halt := _whole(_value(text, "Halt Vector"))) is not None:
                test["halt"] = halt
            at = text.find("Failed Pins:")
            if at >= 0:
                b["pins"] = True
                text = text[at + len("Failed Pins:") :]
            if b["pins"]:
                entries = text.replace(":", " : ").split()
                test["pins"] += [f"{n}:{k}" for n, c, k in zip(entries, entries[1:], entries[2:], strict=False) if c == ":" and k.isdecimal()]

    def terminate(self) -> Iterator[tuple]:
        if self.block:
            yield self._row()

    def _row(self) -> tuple:
        b = self.block
        failed = next((t["number"] for t in b["tests"] if t["failed"]), None)
        tests = [(t["number"], "FAIL" if t["failed"] else "PASS", t["current"], t["pins"], t["halt"]) for t in b["tests"]]
        return b["lot"], b["wafer"], b["device"], *b["place"], b["bin"], b["first"], b["last"], FAILURES.get(failed, "PASS"), tests


def parse_by_line(lines: DataFrame) -> DataFrame:
    """Device blocks of lines (lot, wafer, line_no, line) by the table function."""
    parse = udtf(LogParser, returnType=OUT)
    return parse(lines.select("lot", "wafer", "line_no", "line").asTable().partitionBy("lot", "wafer").orderBy(col("line_no")))
