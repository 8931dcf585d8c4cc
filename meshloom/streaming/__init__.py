"""The same operators over streams of cases."""
