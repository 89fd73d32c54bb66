from .objective import gradient_frame, hessian_frame  # noqa: F401
from .solvers import FitResult, fit_gradient_descent, fit_newton  # noqa: F401
