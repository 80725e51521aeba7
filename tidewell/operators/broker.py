"""Order matching and accounting of a backtest, bar by bar.

Orders queued on a bar are matched against later bars: closes first, then exits, then
entries, then raw orders; each kind has one order waiting at most.  A bar's path is open,
low, high, close.  Fees and slippage are none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

NAN = math.nan
DAY = 86_400_000


@dataclass
class Order:
    id: str
    direction: str
    qty: float
    auto: bool = False
    limit: float = NAN
    stop: float = NAN
    comment: str = ""

    @property
    def priced(self) -> bool:
        return self.limit == self.limit or self.stop == self.stop

    def price(self, bar) -> float:
        """Fill price on a bar, or na."""
        open_, high, low, _ = bar
        has_limit, has_stop = self.limit == self.limit, self.stop == self.stop
        if not self.priced:
            return open_
        long = self.direction == "long"
        # seen from the side of a buyer: mirrored prices for a seller
        o, h, low_, limit, stop = (open_, high, low, self.limit, self.stop) if long else (-open_, -low, -high, -self.limit, -self.stop)
        if has_limit and has_stop:
            return open_ if stop <= o <= limit else self.limit if h >= stop and low_ <= limit else NAN
        if has_limit:
            return open_ if o <= limit else self.limit if low_ <= limit else NAN
        return open_ if o >= stop else self.stop if h >= stop else NAN


@dataclass
class Exit:
    id: str
    from_entry: str
    qty: float
    limit: float = NAN
    stop: float = NAN
    profit: float = NAN
    loss: float = NAN
    trail_points: float = NAN
    trail_offset: float = NAN
    trail_price: float = NAN
    comment: str = ""
    comments: dict = field(default_factory=dict)  # profit, loss, trailing
    line: float = NAN

    def price(self, bar, size: float, average: float) -> tuple[float, str]:
        """(fill price or na, what was hit). The trailing line moves with the bar."""
        open_, high, low, _ = bar
        way = 1 if size > 0 else -1
        limit = self.limit if self.limit == self.limit else average + way * self.profit
        stop = self.stop if self.stop == self.stop else average - way * self.loss
        trails = self.trail_points == self.trail_points or self.trail_price == self.trail_price
        beyond = lambda price, level: way * price <= way * level  # noqa: E731  at or past a stop level
        if beyond(open_, stop):
            return open_, "loss"
        if trails and beyond(open_, self.line):
            return open_, "trailing"
        if way * open_ >= way * limit:
            return open_, "profit"
        best, worst = (high, low) if way > 0 else (low, high)
        if trails:
            offset = self.trail_points if self.trail_offset != self.trail_offset else self.trail_offset
            start = average + way * self.trail_points if self.trail_price != self.trail_price else self.trail_price
            if self.line == self.line or way * best >= way * start:
                moved = best - way * offset
                if self.line != self.line or way * moved > way * self.line:
                    self.line = moved
        won = way * best >= way * limit
        if way < 0 and won:  # the low comes before the high
            return limit, "profit"
        stopped, trailed = beyond(worst, stop), trails and beyond(worst, self.line)
        if stopped and trailed:
            return (stop, "loss") if way * stop > way * self.line else (self.line, "trailing")
        if stopped:
            return stop, "loss"
        if trailed:
            return self.line, "trailing"
        return (limit, "profit") if won else (NAN, "")


@dataclass
class Trade:
    entry_id: str
    exit_id: str
    entry_comment: str
    exit_comment: str
    entry_price: float
    exit_price: float
    entry_bar_index: float
    exit_bar_index: float
    entry_time: float
    exit_time: float
    size: float
    profit: float
    max_runup: float
    max_drawdown: float
    commission: float = 0.0

    @property
    def profit_percent(self) -> float:
        if self.entry_price == 0:
            return 0.0
        return (1 if self.size > 0 else -1) * (self.exit_price - self.entry_price) / self.entry_price * 100


class Broker:
    def __init__(self, capital: float = 100_000.0, qty: float = 1.0, qty_type: str = "fixed", pyramiding: int = 1):
        self.capital, self.qty, self.qty_type, self.pyramiding = capital, qty, qty_type, max(1, int(pyramiding))
        self.size, self.average, self.entry_id, self.entry_comment, self.entries = 0.0, NAN, None, "", 0
        self.entry_bar = self.entry_time = NAN
        self.runup = self.drawdown = 0.0  # of the open trade
        self.entry_order: Order | None = None
        self.raw_order: Order | None = None
        self.exit_order: Exit | None = None
        self.close_order: tuple | None = None  # (id or None for all, qty, comment)
        self.trades: list[Trade] = []
        self.realized = 0.0
        self.peak = self.trough = self.peak_then = self.trough_then = capital
        self.max_drawdown = self.max_runup = 0.0
        self.most = {"all": 0.0, "long": 0.0, "short": 0.0}
        self.allowed = "all"
        self.limits: dict[str, tuple] = {}
        self.day = None
        self.day_fills, self.day_peak, self.day_start = 0, NAN, NAN
        self.losing_days, self.stopped, self.stopped_today = 0, False, False
        self.now = (NAN, NAN)  # bar index and time

    # -- accounting ------------------------------------------------------------------

    def open_profit(self, price: float) -> float:
        return (price - self.average) * self.size if self.size else 0.0

    def equity(self, price: float) -> float:
        return self.capital + self.realized + self.open_profit(price)

    def _auto(self, qty: float, price: float) -> float:
        return self.equity(price) * qty / 100 / price if self.qty_type == "percent_of_equity" else qty / price

    def default_entry_qty(self, price: float) -> float:
        return self.qty if self.qty_type == "fixed" else self._auto(self.qty, price)

    def reduce(self, price: float, qty: float = math.inf, comment: str = "", exit_id: str = "") -> None:
        """Closes up to qty of the position at a price: one ledger row."""
        way, qty = (1 if self.size > 0 else -1), min(qty, abs(self.size))
        profit = (price - self.average) * way * qty
        self.realized += profit
        self.trades.append(Trade(self.entry_id or "", exit_id, self.entry_comment, comment, self.average, price, self.entry_bar, self.now[0], self.entry_time, self.now[1], way * qty, profit, self.runup, self.drawdown))
        self.size -= way * qty
        if self.size == 0:
            self.runup = self.drawdown = 0.0
            self.average, self.entry_id, self.entry_comment, self.entries = NAN, None, "", 0
            self.entry_bar = self.entry_time = NAN
            self.exit_order = None

    def _grow(self, order: Order, price: float, qty: float) -> None:
        way = 1 if order.direction == "long" else -1
        if self.size == 0:
            self.size, self.average, self.entry_id, self.entry_comment, self.entries = way * qty, price, order.id, order.comment, 1
            self.entry_bar, self.entry_time = self.now
        else:
            held = abs(self.size)
            self.average = (self.average * held + price * qty) / (held + qty)
            self.size += way * qty
            self.entries += 1

    # -- a bar -------------------------------------------------------------------------

    def bar(self, index: int, time_ms: float, open_: float, high: float, low: float, close: float) -> None:
        """Matches waiting orders, then takes stock at the close."""
        self.now = (index, time_ms)
        bar = open_, high, low, close
        self._new_day(time_ms)
        if self.size and high == high and low == low:
            way = 1 if self.size > 0 else -1
            best, worst = (high, low) if way > 0 else (low, high)
            self.runup = max(self.runup, (best - self.average) * self.size)
            self.drawdown = max(self.drawdown, (self.average - worst) * self.size)
        if self.close_order:
            (own, qty, comment), self.close_order = self.close_order, None
            if self.size and own in (None, self.entry_id):
                self.reduce(open_, qty, comment, own or "")
        if (e := self.exit_order) and self.size and e.from_entry in ("", self.entry_id):
            price, hit = e.price(bar, self.size, self.average)
            if price == price:
                self.exit_order = None
                self.reduce(price, e.qty, e.comments.get(hit) if e.comments.get(hit) is not None else e.comment, e.id)
        if (o := self.entry_order) and (price := o.price(bar)) == price:
            self.entry_order = None
            self._enter(o, price)
        if (o := self.raw_order) and (price := o.price(bar)) == price:
            self.raw_order = None
            self._net(o, price)
        self._take_stock(close)

    def _enter(self, o: Order, price: float) -> None:
        qty = self._auto(o.qty, price) if o.auto else o.qty
        if not qty > 0:
            return
        if self.size and (self.size > 0) != (o.direction == "long"):
            self.reduce(price, comment=o.comment, exit_id=o.id)
        if "position" in self.limits:
            qty = max(0.0, min(qty, self.limits["position"][0] - abs(self.size)))
        filled = "fills" in self.limits and self.day_fills >= self.limits["fills"][0]
        if self.allowed not in ("all", o.direction) or filled or self.stopped or self.stopped_today or not qty > 0:
            return
        if self.size == 0 or self.entries < self.pyramiding:
            self._grow(o, price, qty)
            self.day_fills += 1

    def _net(self, o: Order, price: float) -> None:
        qty = self._auto(o.qty, price) if o.auto else o.qty
        if not qty > 0:
            return
        if self.size and (self.size > 0) != (o.direction == "long"):
            part = min(qty, abs(self.size))
            self.reduce(price, part, o.comment, o.id)
            qty -= part
        if qty > 0:
            self._grow(o, price, qty)

    def _new_day(self, time_ms: float) -> None:
        if time_ms != time_ms or time_ms // DAY == self.day:
            return
        self.day = time_ms // DAY
        self.day_fills, self.day_peak, self.stopped_today = 0, NAN, False
        if self.day_start == self.day_start:
            self.losing_days = self.losing_days + 1 if self.realized < self.day_start else 0
            if "days" in self.limits and self.losing_days >= self.limits["days"][0]:
                self.stopped = True
        self.day_start = self.realized

    def _take_stock(self, close: float) -> None:
        now = self.equity(close)
        self.peak, self.trough = max(self.peak, now), min(self.trough, now)
        if self.peak - now > self.max_drawdown:
            self.max_drawdown, self.peak_then = self.peak - now, self.peak
        if now - self.trough > self.max_runup:
            self.max_runup, self.trough_then = now - self.trough, self.trough
        self.day_peak = now if self.day_peak != self.day_peak else max(self.day_peak, now)
        for name, loss, peak in (("drawdown", self.max_drawdown, self.peak), ("intraday", self.day_peak - now, self.day_peak)):
            if name in self.limits:
                most, kind = self.limits[name]
                if (loss / peak * 100 if kind == "percent_of_equity" else loss) >= most:
                    if name == "drawdown":
                        self.stopped = True
                    else:
                        self.stopped_today = True
        for name, on in (("all", True), ("long", self.size > 0), ("short", self.size < 0)):
            if on:
                self.most[name] = max(self.most[name], abs(self.size))

    # -- orders ------------------------------------------------------------------------

    def _order(self, waiting: Order | None, id, direction, qty, limit, stop, comment, when) -> Order | None:
        if not when or id is None:
            return waiting
        if direction not in ("long", "short"):
            raise ValueError(f"direction {direction!r}: long or short")
        auto = qty is None and self.qty_type != "fixed"
        qty = self.qty if qty is None else qty
        if not qty > 0 or (waiting and waiting.id != id):
            return waiting
        na = lambda x: NAN if x is None else x
        return Order(id, direction, qty, auto, na(limit), na(stop), comment or "")

    def entry(self, id, direction, qty=None, limit=None, stop=None, comment="", when=True) -> None:
        self.entry_order = self._order(self.entry_order, id, direction, qty, limit, stop, comment, when)

    def order(self, id, direction, qty=None, limit=None, stop=None, comment="", when=True) -> None:
        self.raw_order = self._order(self.raw_order, id, direction, qty, limit, stop, comment, when)

    def _part(self, qty, qty_percent) -> float:
        return qty if qty is not None else abs(self.size) * qty_percent / 100 if qty_percent is not None else math.inf

    def exit(self, id, from_entry="", qty=None, qty_percent=None, profit=None, limit=None, loss=None, stop=None, trail_price=None, trail_points=None, trail_offset=None, comment="", comment_profit=None, comment_loss=None, comment_trailing=None, when=True) -> None:
        part = self._part(qty, qty_percent)
        levels = [NAN if x is None else x for x in (limit, stop, profit, loss, trail_points, trail_offset, trail_price)]
        if not when or id is None or not part > 0 or all(x != x for k, x in enumerate(levels) if k != 5):
            return
        if not self.size or (from_entry or "") not in ("", self.entry_id):
            return
        if self.exit_order and self.exit_order.id != id:
            return
        new = Exit(id, from_entry or "", part, *levels, comment or "", {"profit": comment_profit, "loss": comment_loss, "trailing": comment_trailing})
        if self.exit_order and (new.trail_points == new.trail_points or new.trail_price == new.trail_price):
            new.line = self.exit_order.line
        self.exit_order = new

    def close(self, id, comment="", qty=None, qty_percent=None, immediately=False, when=True, price=NAN) -> None:
        part = self._part(qty, qty_percent)
        if not when or not self.size or id is None or id != self.entry_id or not part > 0:
            return
        if immediately:
            self.reduce(price, part, comment or "", id)
        elif not (self.close_order and self.close_order[0] is None):
            self.close_order = id, part, comment or ""

    def close_all(self, comment="", immediately=False, when=True, price=NAN) -> None:
        if not when or not self.size:
            return
        if immediately:
            self.reduce(price, math.inf, comment or "")
        else:
            self.close_order = None, math.inf, comment or ""

    def cancel(self, id, when=True) -> None:
        if not when or id is None:
            return
        if self.entry_order and self.entry_order.id == id and self.entry_order.priced:
            self.entry_order = None
        if self.exit_order and self.exit_order.id == id:
            self.exit_order = None
        if self.raw_order and self.raw_order.id == id and self.raw_order.priced:
            self.raw_order = None

    def cancel_all(self, when=True) -> None:
        for o in (self.entry_order, self.exit_order, self.raw_order):
            if o:
                self.cancel(o.id, when)

    # -- what scripts read ---------------------------------------------------------------

    def properties(self, close: float) -> dict:
        won, lost = [t for t in self.trades if t.profit > 0], [t for t in self.trades if t.profit < 0]
        gains, losses, profit = sum(t.profit for t in won), sum(t.profit for t in lost), self.open_profit(close)
        mean = lambda xs: sum(xs) / len(xs) if xs else NAN
        share = lambda x, y: 100 * x / y if y else NAN
        return {
            "position_size": self.size,
            "position_avg_price": self.average,
            "position_entry_name": self.entry_id or "",
            "equity": self.equity(close),
            "openprofit": profit,
            "openprofit_percent": share(profit, self.capital + self.realized),
            "netprofit": self.realized,
            "netprofit_percent": share(self.realized, self.capital),
            "grossprofit": gains,
            "grossprofit_percent": share(gains, self.capital),
            "grossloss": -losses,
            "grossloss_percent": share(-losses, self.capital),
            "closedtrades": len(self.trades),
            "opentrades": int(self.size != 0),
            "wintrades": len(won),
            "losstrades": len(lost),
            "eventrades": len(self.trades) - len(won) - len(lost),
            "avg_trade": mean([t.profit for t in self.trades]),
            "avg_trade_percent": mean([t.profit_percent for t in self.trades]),
            "avg_winning_trade": mean([t.profit for t in won]),
            "avg_winning_trade_percent": mean([t.profit_percent for t in won]),
            "avg_losing_trade": mean([-t.profit for t in lost]),
            "avg_losing_trade_percent": mean([-t.profit_percent for t in lost]),
            "max_drawdown": self.max_drawdown,
            "max_drawdown_percent": share(self.max_drawdown, self.peak_then),
            "max_runup": self.max_runup,
            "max_runup_percent": share(self.max_runup, self.trough_then),
            "max_contracts_held_all": self.most["all"],
            "max_contracts_held_long": self.most["long"],
            "max_contracts_held_short": self.most["short"],
            "initial_capital": self.capital,
            "default_qty_value": self.qty,
            "account_currency": "USD",
        }

    def closed(self, name: str, i: int):
        """A field of the i-th closed trade."""
        if not 0 <= i < len(self.trades):
            if i == -1 and not self.trades:
                return NAN
            raise IndexError(f"closed trade {i} of {len(self.trades)}")
        t = self.trades[int(i)]
        held = abs(t.entry_price * t.size)
        more = {"max_runup_percent": 100 * t.max_runup / held if held else NAN, "max_drawdown_percent": 100 * t.max_drawdown / held if held else NAN}
        return more[name] if name in more else getattr(t, name)

    def opened(self, name: str, i: int, close: float):
        """A field of the open trade."""
        if i != 0 or not self.size:
            return NAN
        held = abs(self.average * self.size)
        return {"entry_price": self.average, "entry_bar_index": self.entry_bar, "entry_time": self.entry_time, "entry_id": self.entry_id or "", "entry_comment": self.entry_comment, "size": self.size, "profit": self.open_profit(close), "profit_percent": 100 * self.open_profit(close) / held if held else NAN, "max_runup": self.runup, "max_drawdown": self.drawdown, "max_runup_percent": 100 * self.runup / held if held else NAN, "max_drawdown_percent": 100 * self.drawdown / held if held else NAN, "commission": 0.0}[name]
