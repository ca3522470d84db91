"""tagwarden: entitlement and run-log analytics as lazy Spark DataFrame operators.

Families:
  A  managed tables      -> tagwarden.sources.tables
  B  tag classification  -> tagwarden.operators.classify
  C  grants              -> tagwarden.operators.grants
  D  role membership     -> tagwarden.operators.members
  E  run-log analytics   -> tagwarden.operators.logs

Operators take and return lazy DataFrames. The table jobs of family A and the grant sync write when
called, and the smoke check reads a few counts to the driver.
"""

__version__ = "0.1.0"
