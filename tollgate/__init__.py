"""tollgate — AI-egress traffic analytics as Spark DataFrame jobs.

Sub-packages:
  functions/  column-level building blocks (redaction chain, predicates, constants)
  sources/    readers/writers (driver tables, catalogue, derived request logs)
  operators/  one module per job (provider resolution, approvals, bursts, ...)
  plans/      composed jobs (policy cascade) and the registered query set
  streaming/  Structured Streaming form of the policy job
"""

__version__ = "0.1.0"
