"""Source texts the tests read."""

PROBE = '''package org.demo.tide;

/** A gauge at one pier. */
public class Probe {

    private final double zero;
    private double drift;

    public Probe(double zero) {
        this.zero = zero;
    }

    public void settle(double seen, double known) {
        drift = (drift + seen - known) / 2;
    }

    public double level(double raw) {
        return raw - zero - drift;
    }

    @Override
    public String label(int digits) {
        return String.format("%." + digits + "f", zero);
    }
}
'''

DAY = '''package org.demo.tide;

import java.util.Arrays;
import java.util.stream.DoubleStream;

/**
 * Readings of a day
 * by the hour.
 */
public class TideDay {

    private final double[] hours = new double[24];

    public TideDay() {
        Arrays.fill(hours, Double.NaN);
    }

    public double span() {
        double low = DoubleStream.of(hours).min().orElse(0);
        return DoubleStream.of(hours).max().orElse(low) - low;
    }

    public String strength(double wind) {
        double reach = span() + wind;
        if (reach > 6) {
            return "storm";
        } else if (reach > 4) {
            return "spring";
        } else if (Math.abs(reach) < 1) {
            return "slack";
        }
        return "usual";
    }

    public int gaps() {
        int missing = 0;
        for (double hour : hours) {
            if (Double.isNaN(hour)) missing++;
        }
        return missing;
    }
}
'''

WATCH = '''package org.demo.tide;

public class Watch extends Station implements Reporter {

    private final TideDay day;

    public Watch(TideDay day) {
        this.day = day;
    }

    public String report(Probe probe, double raw) {
        while (day.gaps() > 12) {
            rest(day.gaps());
        }
        if (raw != raw) return alarm(probe);
        return day.strength(probe.level(raw));
    }

    public double glance() {
        return day.span() / 2;
    }
}
'''

TOOLS = '''"""Helpers."""
import os, json as j
from . import base


class Box(base.Thing, Mixin):
    """A box."""

    class Lid:
        pass

    def __init__(self, size=default()):
        self.size = size

    @property
    def area(self) -> int:
        if self.size > limit(1):
            return grow(self.size)
        return self.size


def walk(items):
    \'\'\'Visit all.\'\'\'
    for item in items:
        while item:
            item = step(item)
    return Box(len(items)).area


if __name__ == "__main__":
    walk([])
'''


def write_pier(root):
    files = {
        "src/Probe.java": PROBE, "src/TideDay.java": DAY, "src/Watch.java": WATCH,
        "tools/_box.py": TOOLS, "tools/README.md": "text",
        "target/Old.java": "class Old {}", ".git/x/Hidden.java": "class Hidden {}",
    }
    for path, text in files.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return root
