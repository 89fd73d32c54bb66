from .expressions import (  # noqa: F401
    irls_weight, linear_predictor, log_loss_term, residual, sigmoid, uniform,
)
