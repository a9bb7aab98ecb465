"""Portfolio and rewards analytics as Spark jobs.

Operators are functions from DataFrame to DataFrame; nothing here holds a
session, collects rows or starts an action unless its docstring says so.
"""
