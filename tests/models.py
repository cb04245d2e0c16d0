"""Sequential interpreters the set-based operators are compared with: one change, one edit at a time."""

from __future__ import annotations


class ResponseModel:
    """Answers and texts of one response of the `survey` fixture."""

    TYPES = {10: "radio", 11: "checkbox", 12: "checkbox", 13: "text"}
    ORDINALS = (1, 2, 3)

    def __init__(self):
        self.answers: dict[tuple[int, int], list] = {}
        self.texts: dict[int, list] = {}
        self.updated = None

    def save(self, question, ordinal, text, ts):
        known = question in self.TYPES
        if ordinal is not None and ordinal < 0:
            for (q, option) in list(self.answers):
                if self.TYPES[q] == "checkbox" and option == q * 100 - ordinal:
                    del self.answers[q, option]
        elif ordinal is not None and ordinal > 0:
            if known and ordinal in self.ORDINALS:
                self._click(question, question * 100 + ordinal, ts)
        elif ordinal is None and known:
            self._text(question, text or None, ts)
        self.updated = ts

    def _click(self, question, option, ts):
        if self.TYPES[question] == "radio":
            row = next((k for k in self.answers if k[0] == question), None)
            if row is None:
                self.answers[question, option] = [ts, 0, ts]
            else:
                created, revision, _ = self.answers.pop(row)
                self.answers[question, option] = [created, revision + 1, ts]
        else:
            # A checked box stays as it is; a repeated click on a text question's option would break its key.
            self.answers.setdefault((question, option), [ts, 0, ts])

    def _text(self, question, text, ts):
        row = self.texts.get(question)
        if text is None:
            self.texts.pop(question, None)
        elif row is None:
            self.texts[question] = [text, ts, 0, ts]
        else:
            self.texts[question] = [text, row[1], row[2] + 1, ts]


def pack(orders: dict) -> dict:
    return {item: i + 1 for i, item in enumerate(sorted(orders, key=orders.get))}


def insert(orders: dict, item, position, capacity) -> dict:
    """Shift if the position is taken, insert, pack. Orders above the capacity do not fit their type."""
    position = max(orders.values(), default=0) + 1 if position is None else position
    shifted = dict(orders)
    if position in orders.values():
        shifted = {k: o + 1 if o >= position else o for k, o in orders.items()}
    shifted[item] = position
    if max(shifted.values()) > capacity:
        return orders
    return pack(shifted)


def move(orders: dict, item, position) -> dict:
    """Shift if another item is there, set the position, pack."""
    moved = dict(orders)
    if position is not None:
        if any(o == position and k != item for k, o in orders.items()):
            moved = {k: o + 1 if o >= position else o for k, o in orders.items()}
        moved[item] = position
    return pack(moved)
