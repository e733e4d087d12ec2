"""SQL for another engine that gives the results of the registered queries.

Written apart from the Spark plans, mostly with plain windows over whole tables.
"""
