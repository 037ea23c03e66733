"""taskgrid: task-list analytics on Spark DataFrames.

Three families of operators, all functions from DataFrames to DataFrames:

* ``operators.quality`` – data-quality profile of a task list,
* ``operators.assign``  – dividing rows among analysts,
* ``operators.compare`` – diffing two versions of a list.

``plans`` bundles them into the three end-to-end flows (analyse, launch,
compare); ``sources`` and ``sinks`` read and write task lists.
"""

from taskgrid.config import DEFAULT, TaskConfig

__all__ = ["DEFAULT", "TaskConfig"]
